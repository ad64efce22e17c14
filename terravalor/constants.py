"""Tables and thresholds that results depend on."""

from __future__ import annotations

# ---- property types -------------------------------------------------------------
CONDO, TOWNHOME, DETACHED, DUPLEX = "condo", "townhome", "detached", "duplex"
DEVELOPMENT_LAND = "development_land"
RESIDENTIAL_TYPES = (DETACHED, TOWNHOME, CONDO)

# ---- zoning prefixes (fixed values) ----------------------------------------------
INDUSTRIAL_ZONES = (
    "I-1", "I-2", "I-3", "I-4", "M-1", "M-1A", "M-1B", "M-2", "IC-1", "IC-2", "IC-3",
)
DETACHED_ZONES = ("RS-1", "RS-2", "RS-3", "RS-5", "RS-6", "RS-7", "RT-", "RA-1", "FSHCA", "R1-1")
TOWNHOME_ZONES = ("RM-1", "RM-2", "RM-3")
CONDO_ZONES = ("RM-4", "RM-5", "RM-6", "FM-1", "DD", "HA-", "FC-", "CWD")
COMMERCIAL_ZONES = ("C-1", "C-2", "C-3", "C-5", "C-6", "MC-1", "MC-2")
EXCLUDED_ZONES = ("I-1", "I-2", "I-3", "I-4", "M-1", "M-2")
HIGH_RISE_ZONES = ("RM-4", "RM-5", "RM-6", "FM-1", "DD", "C-3")

# ---- listing types (fixed values) --------------------------------------------------
LISTING_TYPES = {
    "Apartment/Condo": CONDO,
    "Townhouse": TOWNHOME,
    "1/2 Duplex": DUPLEX,
    "House/Single Family": DETACHED,
    "HOUSE": DETACHED,
    "House with Acreage": DETACHED,
}
TYPE_FALLBACKS = {DUPLEX: DETACHED}
CROSS_TYPE_PREFERENCE = {
    TOWNHOME: (CONDO, DETACHED),
    CONDO: (TOWNHOME, DETACHED),
    DETACHED: (CONDO, TOWNHOME),
    DUPLEX: (DETACHED, TOWNHOME),
}

# ---- listing sub-areas (fixed values) ----------------------------------------------
SUB_AREAS = {
    "VVWDT": "Downtown", "VVWWE": "West End", "VVWCB": "Coal Harbour",
    "VVWYA": "Yaletown", "VVWKT": "Kitsilano", "VVWFA": "Fairview",
    "VVWPG": "Point Grey", "VVWKE": "Kerrisdale", "VVWSH": "Shaughnessy",
    "VVWOA": "Oakridge", "VVWMR": "Marpole", "VVWCA": "Cambie",
    "VVWSA": "South Cambie", "VVWUL": "University/UBC", "VVWDN": "Dunbar",
    "VVWSO": "South Granville", "VVWQU": "Quilchena", "VVWAR": "Arbutus",
    "VVWMK": "MacKenzie Heights",
    "VVEST": "Strathcona", "VVEDT": "Downtown East", "VVEGW": "Grandview-Woodland",
    "VVERE": "Renfrew", "VVESU": "Sunrise", "VVEKO": "Kensington-Cedar Cottage",
    "VVEKN": "Knight", "VVEVI": "Victoria", "VVEFR": "Fraser",
    "VVECO": "Collingwood", "VVESV": "South Vancouver", "VVEKL": "Killarney",
    "VVEMP": "Mount Pleasant", "VVEHA": "Hastings",
}

# ---- local areas by code and their census figures (fixed values) ---------------------
AREA_NAMES = {
    "1": "West Point Grey", "2": "Kitsilano", "3": "Dunbar-Southlands", "4": "Arbutus Ridge",
    "5": "Kerrisdale", "6": "Shaughnessy", "7": "Fairview", "8": "South Cambie",
    "9": "Oakridge", "10": "Marpole", "11": "Riley Park", "12": "Sunset",
    "13": "Mount Pleasant", "14": "Grandview-Woodland", "15": "Hastings-Sunrise",
    "16": "Kensington-Cedar Cottage", "17": "Killarney", "18": "Victoria-Fraserview",
    "19": "Strathcona", "20": "Renfrew-Collingwood", "21": "Downtown", "22": "West End",
}
# area name: median income, population density, % owners, % immigrants, % university
CENSUS_BY_AREA = {
    "West Point Grey": (101000.0, 3800.0, 55.0, 42.0, 58.0),
    "Kitsilano": (84000.0, 7200.0, 38.0, 35.0, 55.0),
    "Dunbar-Southlands": (106000.0, 3200.0, 72.0, 45.0, 52.0),
    "Arbutus Ridge": (74000.0, 4500.0, 52.0, 48.0, 42.0),
    "Kerrisdale": (73500.0, 4800.0, 55.0, 52.0, 45.0),
    "Shaughnessy": (106000.0, 2500.0, 78.0, 48.0, 55.0),
    "Fairview": (81000.0, 9500.0, 35.0, 38.0, 52.0),
    "South Cambie": (99000.0, 5200.0, 55.0, 42.0, 50.0),
    "Oakridge": (72000.0, 5800.0, 60.0, 58.0, 40.0),
    "Marpole": (69000.0, 6800.0, 42.0, 52.0, 35.0),
    "Riley Park": (107000.0, 5500.0, 55.0, 38.0, 48.0),
    "Sunset": (87000.0, 6200.0, 65.0, 55.0, 30.0),
    "Mount Pleasant": (79500.0, 8200.0, 32.0, 35.0, 50.0),
    "Grandview-Woodland": (78000.0, 6800.0, 30.0, 38.0, 42.0),
    "Hastings-Sunrise": (78000.0, 5800.0, 52.0, 48.0, 32.0),
    "Kensington-Cedar Cottage": (91000.0, 6500.0, 55.0, 50.0, 35.0),
    "Killarney": (87000.0, 5500.0, 68.0, 58.0, 30.0),
    "Victoria-Fraserview": (87000.0, 5200.0, 70.0, 55.0, 28.0),
    "Strathcona": (41600.0, 5500.0, 18.0, 42.0, 28.0),
    "Renfrew-Collingwood": (82000.0, 7500.0, 48.0, 55.0, 30.0),
    "Downtown": (72000.0, 18000.0, 35.0, 40.0, 52.0),
    "West End": (65000.0, 22000.0, 28.0, 38.0, 48.0),
}
WEST_SIDE_AREAS = (
    "Arbutus Ridge", "Dunbar-Southlands", "Kerrisdale", "Kitsilano", "Shaughnessy", "South Cambie",
    "West End", "West Point Grey", "Fairview", "Marpole", "Oakridge",
)

# ---- structure estimates (fixed values) ------------------------------------------------
SQM_TO_SQFT = 10.7639
STORY_BREAKPOINTS = ((2_000.0, 1.5), (5_000.0, 3.0), (10_000.0, 6.0), (20_000.0, 12.0), (50_000.0, 20.0))
STORIES_ABOVE_LAST = 35.0
STORIES_BY_ZONE = {
    "RS": 2.0, "RT": 2.5, "RM-1": 3.0, "RM-2": 3.0, "RM-3": 4.0, "RM-3A": 4.0,
    "RM-4": 6.0, "RM-5": 6.0, "RM-6": 6.0, "FM-1": 12.0, "C-1": 4.0, "C-2": 6.0,
    "C-3A": 10.0, "CD-1": 6.0,
}
STORIES_DEFAULT = 2.0
EFFICIENCY = {DETACHED: 0.90, TOWNHOME: 0.85, CONDO: 0.85}

# ---- assembly corridors: name, lat min, lat max, lon min, lon max, base premium ----------
CORRIDORS = (
    ("Broadway Plan", 49.26, 49.27, -123.18, -123.07, 0.15),
    ("Cambie Corridor", 49.21, 49.26, -123.12, -123.10, 0.12),
    ("Oakridge Municipal Town Centre", 49.225, 49.235, -123.12, -123.11, 0.13),
    ("Joyce-Collingwood", 49.237, 49.243, -123.03, -123.02, 0.10),
    ("Metrotown", 49.224, 49.232, -123.005, -122.995, 0.14),
    ("Brentwood-Holdom", 49.264, 49.270, -123.00, -122.98, 0.11),
    ("Lougheed Town Centre", 49.248, 49.254, -122.90, -122.88, 0.10),
)
# Rapid-transit stations (lat, lon), fixed values.
STATIONS = (
    (49.2633, -123.0694), (49.2627, -123.1146), (49.2625, -123.0686), (49.2483, -123.1160),
    (49.2294, -123.1166), (49.2125, -123.1168), (49.2384, -123.0318), (49.2267, -122.9997),
    (49.2660, -122.9920), (49.2486, -122.8967), (49.2530, -122.9180), (49.2050, -123.1174),
    (49.2855, -123.1117), (49.2839, -123.0536), (49.2627, -123.0687),
)
MULTI_FAMILY_ZONES = (
    "RM", "FM", "CD", "C-2", "C-3", "MC", "RM-3A", "RM-4", "RM-5", "RM-6", "RM-7", "RM-8",
    "RM-9", "RM-10", "RM-11", "RM-12", "FC-1", "FC-2", "FCCDD",
)
# Major projects: name, lat, lon, units, tenure, status (fixed values).
PROJECTS = (
    ("Oakridge Park", 49.2275, -123.1170, 4300, "strata", "under_construction"),
    ("Senakw", 49.2726, -123.1380, 6000, "rental", "under_construction"),
    ("Broadway Plan SkyTrain Corridor", 49.2630, -123.1150, 30000, "mixed", "planned"),
    ("Jericho Lands", 49.2680, -123.1900, 13000, "mixed", "planned"),
    ("River District", 49.2070, -123.0360, 7000, "strata", "under_construction"),
    ("Lougheed Town Centre", 49.2490, -122.8960, 5500, "mixed", "approved"),
    ("Brentwood Town Centre", 49.2662, -122.9920, 8000, "strata", "under_construction"),
    ("Metrotown South", 49.2240, -123.0000, 4000, "mixed", "approved"),
    ("Heather Lands", 49.2450, -123.1140, 1700, "mixed", "approved"),
    ("Fraser Mills", 49.2190, -122.8530, 6200, "mixed", "under_construction"),
    ("Capstan Village", 49.1850, -123.1360, 5000, "strata", "under_construction"),
)
# Price effect per 500 units of new supply, by type: strata, rental, mixed (fixed values).
SUPPLY_EFFECT = {
    CONDO: (-0.005, -0.003, -0.004),
    TOWNHOME: (-0.003, -0.001, -0.002),
    DETACHED: (-0.001, -0.001, -0.001),
    DEVELOPMENT_LAND: (0.005, 0.005, 0.005),
}
COMPLETED_EFFECT = 0.002
# Price effect of a rate rise of one percentage point, by type (fixed values).
RATE_EFFECT = {CONDO: -0.05, TOWNHOME: -0.04, DETACHED: -0.03, DEVELOPMENT_LAND: -0.02}
RATE_EFFECT_OTHER = -0.03

# ---- reference points (fixed values) ------------------------------------------------------
DOWNTOWN = (49.2827, -123.1207)
CBD = (49.2856, -123.1115)

# ---- similarity weights (fixed values) ------------------------------------------------------
ASSESSMENT_WEIGHTS = {
    "proximity": 0.30, "value_similarity": 0.25, "year_built": 0.15, "zoning_match": 0.15,
    "recency": 0.15,
}
LISTING_WEIGHTS = {
    "proximity": 0.20, "living_area": 0.25, "value_similarity": 0.10, "year_built": 0.10,
    "zoning_match": 0.10, "bedroom_match": 0.10, "recency": 0.15,
}
ZONE_CATEGORIES = (
    ("residential", ("RS", "RT", "RM", "RR", "RA", "RF")),
    ("commercial", ("C", "CD", "CR", "CS", "FC")),
    ("industrial", ("I", "IC", "IM", "IH", "IL")),
    ("comprehensive", ("DD", "HA")),
)

# ---- news keywords (fixed values, matched case-folded) ----------------------------------------
NEWS_KEYWORDS = (
    "real estate", "housing market", "home sales", "home prices",
    "condo", "townhouse", "townhome", "detached", "single-family",
    "presale", "pre-sale", "new construction", "new build",
    "development", "rezoning", "rezone", "density", "tower",
    "housing start", "building permit", "construction",
    "mortgage", "interest rate", "bank of canada", "benchmark price",
    "sales-to-active", "price index", "affordability",
    "property tax", "assessment", "property value",
    "mls", "rebgv", "gvr", "bcrea", "cmhc", "realtor", "listing",
    "rennie", "sold", "asking price", "over asking",
    "strata", "rental", "vacancy", "lease",
    "vancouver housing", "metro vancouver",
)

# ---- price brackets of the transfer-tax histogram (fixed values) ---------------------------------
PRICE_BRACKETS = (
    0, 250_000, 500_000, 750_000, 1_000_000, 1_500_000, 2_000_000, 3_000_000, 5_000_000,
)
