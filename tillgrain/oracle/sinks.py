"""SQL checks of the result sinks."""

from __future__ import annotations

from tillgrain.functions import labels
from tillgrain.oracle import dashboard, evaluate, forecast, impute  # noqa: F401  (blocks)
from tillgrain.oracle.base import query, r, usum

SQL = {
    "sink_tables": f"""SELECT 'daily' AS sink, count(*) AS rows, CAST(sum(orders) AS DOUBLE) AS total FROM daily_rev
        UNION ALL SELECT 'predictions', count(*), {r(usum(' + '.join(labels.PERIODS)))} FROM ({forecast.wide_grid('service', 'slot_')})
        UNION ALL SELECT 'imputed', count(*), CAST(sum(quantity) AS DOUBLE) FROM imp_made
        UNION ALL SELECT 'metrics', count(*), CAST(sum(n) AS DOUBLE) FROM (SELECT user_id, fold, count(*) AS n FROM scored GROUP BY ALL)""",
}

ORACLES = {key: query(sql) for key, sql in SQL.items()}
