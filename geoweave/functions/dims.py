"""Legend, crosswalks, products, zones and ranges, as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ANCHORS = (2000, 2005, 2010, 2015, 2020)

# Unified legend, code to name.
LEGEND = {
    0: "NoData",
    1: "Forest",
    2: "Shrub",
    3: "Meadow steppe",
    4: "Real steppe",
    5: "Dry steppe",
    6: "Desert steppe",
    7: "Wetland",
    8: "Water",
    9: "Cropland",
    10: "Built-up",
    11: "Bare area",
    12: "Desert",
    13: "Sand",
    14: "Ice",
}

# Unified code to super-class (0 is no data), and the super-classes.
UNIFIED_TO_L1 = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 7: 4, 8: 5, 9: 6, 10: 7, 11: 8, 12: 8, 13: 8, 14: 9}
L1_NAMES = {1: "Forest", 2: "Shrub", 3: "Grassland", 4: "Wetland", 5: "Water", 6: "Cropland", 7: "Built-up", 8: "Bare", 9: "Ice"}
L1_CLASSES = tuple(L1_NAMES)
#: Super-classes without a second decision, and the unified code each stands for.
L1_DIRECT = {1: 1, 2: 2, 4: 7, 5: 8, 6: 9, 7: 10, 9: 14}
#: Super-classes with a second decision, and their members.
SUBCLASSES = {3: (3, 4, 5, 6), 8: (11, 12, 13)}
#: Products (ids) that take part in the second decision.
AUTHORITIES = {3: (1, 8), 8: (1, 7)}

# Products. id -> (name, weight, first year, last year, step, specialist super-classes).
PRODUCTS = {
    1: ("plateau14", 1.00, 1990, 2020, 5, ()),
    2: ("fcs30d", 0.90, 1985, 2022, 1, ()),
    3: ("clcd", 0.85, 1985, 2023, 1, ()),
    4: ("cci", 0.85, 1992, 2022, 1, ()),
    5: ("igbp", 0.75, 2001, 2024, 1, ()),
    6: ("worldcover", 0.80, 2020, 2021, 1, ()),
    7: ("sandy", 0.95, 1990, 2020, 5, (8,)),
    8: ("grassland_mask", 0.50, 1991, 2020, 1, (3,)),
}
#: The grassland mask is a weak authority: its error is at least this in the second decision.
SUB_ERROR_FLOOR = 0.4
SOFT_PRODUCT = 8

# Native code to unified code, by product.
CROSSWALK = {
    1: {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12, 13: 13, 14: 14},
    2: {
        0: 0, 10: 9, 11: 9, 12: 9, 20: 9, 51: 1, 52: 1, 61: 1, 62: 1, 71: 1, 72: 1, 81: 1, 82: 1, 91: 1, 92: 1,
        120: 2, 121: 2, 122: 2, 130: 4, 140: 4, 150: 11, 152: 11, 153: 11, 181: 7, 182: 7, 183: 7, 184: 7, 185: 7,
        186: 7, 187: 7, 190: 10, 200: 11, 201: 12, 202: 13, 210: 8, 220: 14, 250: 0, 255: 0,
    },
    3: {0: 0, 1: 9, 2: 1, 3: 2, 4: 4, 5: 8, 6: 14, 7: 11, 8: 10, 9: 7},
    4: {
        0: 0, 10: 9, 11: 9, 12: 9, 20: 9, 30: 9, 40: 4, 50: 1, 60: 1, 61: 1, 62: 1, 70: 1, 71: 1, 72: 1, 80: 1,
        81: 1, 82: 1, 90: 1, 100: 2, 110: 4, 120: 2, 121: 2, 122: 2, 130: 4, 140: 4, 150: 11, 151: 11, 152: 11,
        153: 11, 160: 7, 170: 7, 180: 7, 190: 10, 200: 11, 201: 12, 202: 13, 210: 8, 220: 14, 32767: 0,
    },
    5: {
        0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 4, 9: 4, 10: 4, 11: 7, 12: 9, 13: 10, 14: 9, 15: 14,
        16: 11, 17: 8, 255: 0,
    },
    6: {0: 0, 10: 1, 20: 2, 30: 4, 40: 9, 50: 10, 60: 11, 70: 14, 80: 8, 90: 7, 95: 7, 100: 4},
    7: {0: 0, 2: 13, 3: 13, 4: 12, 5: 12, 6: 12, 7: 12},
    8: {0: 0, 1: 4},
}

# Zones of the unified classes.
ZONES = {1: (1, 3), 2: (4,), 3: (5,), 4: (6,), 5: (9,), 6: (13,), 7: (11, 12), 8: (2, 7, 8, 10, 14)}
ZONE_NAMES = {
    1: "Forest/Meadow", 2: "Real steppe", 3: "Dry steppe", 4: "Desert steppe",
    5: "Cropland", 6: "Sandy land", 7: "Desert/Barren", 8: "Other",
}

# Degradation rank of a class, and the two sets of the strict scheme.
RANK = {1: 0, 3: 1, 4: 2, 5: 3, 6: 4, 13: 5, 11: 6, 12: 7}
STEPPE = (1, 3, 4, 5, 6)
ARID = (11, 12, 13)

# Plausible ranges of driver variables.
PLAUSIBLE = {
    "CDD": (0, 366), "CWD": (0, 366), "GSL": (0, 366), "R10": (0, 366), "R20": (0, 366),
    "Rx1day": (0, 1000), "Rx5day": (0, 2000),
    "Tn10p": (-1, 101), "Tn90p": (-1, 101), "Tx10p": (-1, 101), "Tx90p": (-1, 101),
    "TNn": (-80, 80), "TNx": (-80, 80), "TXn": (-80, 80), "TXx": (-80, 80),
    "phenology": (1, 366), "ndvi": (-0.2, 1.0), "elevation": (-500, 9000), "slope": (0, 90), "aspect": (0, 360),
}


def error_rate(weight: float, delta: float = 0.0) -> float:
    """Error of a product's vote: one less its weight, at least 0.01."""
    return max(0.01, 1.0 - min(1.0, max(0.01, weight + delta)))


def available(product: int, year: int) -> bool:
    _, _, first, last, step, _ = PRODUCTS[product]
    return first <= year <= last and (year - first) % step == 0


def crosswalk(spark: SparkSession) -> DataFrame:
    """(product_id, k, native, unified): k numbers a product's codes from 0 by native code."""
    rows = [(p, k, n, u) for p, codes in CROSSWALK.items() for k, (n, u) in enumerate(sorted(codes.items()))]
    return spark.createDataFrame(rows, "product_id int, k int, native int, unified int")


def legend(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEGEND.items()), "class int, name string")


def products(spark: SparkSession) -> DataFrame:
    rows = [(p, n, w, first, last, step, list(spec)) for p, (n, w, first, last, step, spec) in PRODUCTS.items()]
    return spark.createDataFrame(rows, "product_id int, name string, weight double, first_year int, last_year int, year_step int, specialist array<int>")
