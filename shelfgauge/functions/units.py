"""Units a package size can be stated in."""

# Ounces in one of each unit, and the words that mark a count.
OUNCES_IN = {"oz": 1.0, "lb": 16.0, "qt": 32.0, "l": 33.81, "gal": 128.0}
COUNT_WORDS = ("bunch", "ct", "each", "pk", "roll")

# Fixed value: the time zone in which run times are shown.
DISPLAY_ZONE = "US/Mountain"
