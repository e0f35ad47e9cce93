"""Repair rules of the categories, as (old size, new size)."""

# Literal repairs of size texts.
VEGETABLE_REPAIRS = (
    ("each", "1 each"),
    ("1 pt / 10 oz", "10 oz"),
    ("4 ct / 3 oz", "12 oz"),
    ("4 ct / 10.5 oz", "42 oz"),
    ("4 ct / 15.25 oz", "61 oz"),
)
FRUIT_REPAIRS = (("1 pt / 10 oz", "10 oz"),)
MILK_REPAIRS = (
    ("1/2 gal", "0.5 gal"),
    ("6 ct / 8 fl oz", "48 fl oz"),
)
TEA_REPAIRS = (
    ("12 bottles / 16 fl oz", "192 fl oz"),
    ("12 ct / 1.16 oz", "12 ct"),
    ("16 ct / .99 oz", "16 ct"),
    ("16 ct / 1.13 oz", "16 ct"),
    ("4 ct / 12 oz", "48 fl oz"),
)
EGG_REPAIRS = (("large dozen", "12 ct"),)
PEANUT_BUTTER_REPAIRS = (("8 ct / 1.15 oz", "9.2 oz"),)

# Repairs of single products, as (description, old size, new size).
MEAT_REPAIRS = (
    ("Simple Truth Grass Fed 85/15 Lean Ground Beef BIG Deal!", "3 ct / 1 lb", "3 lb"),
    ("Schweid & Sons® Butcher's Blend Burger Patties", "4 ct / 5.3 oz", "21.2 oz"),
    ("Schweid & Sons Signature Series Chuck Brisket Burger Patties", "4 ct / 5.3 oz", "21.2 oz"),
    ("Private Selection® 80/20 Angus Beef Ground Chuck Patties", "2 ct / 14 oz", "14 oz"),
    ("MorningStar Farms® Veggie Breakfast Original Vegan Sausage Patties", "12 ct / 1.3 oz",
     "15.600000000000001 oz"),
    ("MorningStar Farms® Veggie Breakfast Maple Flavored Vegan Sausage Patties", "6 ct / 1.3 oz",
     "7.800000000000001 oz"),
    ("MorningStar Farms® Veggie Breakfast Hot and Spicy Vegan Sausage Patties", "6 ct / 1.3 oz",
     "7.800000000000001 oz"),
    ("MorningStar Farms® Spicy Black Bean Veggie Burgers", "8 ct / 2.4 oz", "19.2 oz"),
    ("MorningStar Farms® Original Vegan Chicken Patties", "8 ct / 2.5 oz", "20.0 oz"),
    ("MorningStar Farms® Grillers Veggie Burgers", "4 ct / 2.3 oz", "9.2 oz"),
    ("MorningStar Farms® Grillers Prime Veggie Burgers", "4 ct / 2.5 oz", "10.0 oz"),
    ("MorningStar Farms® Garden Veggie Veggie Burgers", "4 ct / 2.4 oz", "9.6 oz"),
    ("MorningStar Farms® Buffalo Vegan Chicken Patties", "4 ct / 2.5 oz", "10.0 oz"),
    ("Kroger® Lean Ground Beef Chuck 80/20 Homestyle Hamburger Patties", "10 ct / 35.2 oz",
     "35.2 oz"),
    ("Kroger® Homestyle 93/7 Lean Ground Beef Patties", "4 ct / 4.8 oz", "16 oz"),
    ("Kroger® Homestyle 80/20 Ground Beef Patties", "4 ct / 19.2 oz", "19.2 oz"),
    ("Johnsonville® Original Recipe Breakfast Pork Sausage Links", "12 ct / 12 oz", "12 oz"),
    ("Hormel® Natural Choice® Sliced Oven Roasted Deli Turkey Lunch Meat", "2 ct / 7 oz", "14 oz"),
    ("Hormel® Natural Choice® Sliced Honey Deli Ham Lunch Meat Double Pack", "2 ct / 7 oz",
     "14 oz"),
)

# Fixed value: the brand whose packs are multiplied out.
PACK_BRAND = "Morningstar Farms"
