"""Parameters of the registered queries."""

AS_OF = "2001-08-01"
#: days past AS_OF that predictions cover
PERIOD = 90
#: days past AS_OF that features and the longest prediction cover
LONG_PERIOD = 240
#: days the validation against recent history looks ahead
NEAR = 30
