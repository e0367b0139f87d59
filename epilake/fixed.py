"""Fixed values.

These values must equal the reference's for results to agree; they are
stated plainly, in the reference's order, as data. Everything else in
the library is derived from them by rule.
"""

# --- fixed values: countries (code, name, district share, urban share,
#     population, latitude range, longitude range) ---------------------------
COUNTRIES = [
    ("KE", "Kenya", 0.30, 0.27, 56_000_000, (-4.7, 4.6), (33.9, 41.9)),
    ("NG", "Nigeria", 0.25, 0.52, 232_000_000, (4.3, 13.9), (2.7, 14.6)),
    ("ZA", "South Africa", 0.20, 0.67, 64_000_000, (-34.0, -22.0), (16.5, 32.9)),
]

# --- fixed values: regions per country, in order (first region is special) ---
REGIONS = {
    "KE": ["Nairobi", "Coast", "Rift Valley", "Central", "Eastern", "Western", "Nyanza"],
    "NG": ["Lagos", "Kano", "Kaduna", "Rivers", "Oyo", "Borno", "Enugu"],
    "ZA": ["Gauteng", "KwaZulu-Natal", "Western Cape", "Eastern Cape", "Limpopo", "Mpumalanga", "Free State"],
}
FIRST_REGION_DISTRICT_SHARE = 0.4
URBAN_PROB_FIRST_REGION = 0.3
URBAN_PROB_OTHER_REGION = 0.15

# --- fixed values: population and density by class -------------------------
POPULATION_RANGE = {"Urban": (50_000, 500_000), "Rural": (5_000, 50_000)}
DENSITY_RANGE = {"Urban": (100, 1000), "Rural": (10, 100)}

# --- fixed values: facility types (type, level, capacity range, staff range,
#     minimum population density, weight) ---------------------------------------
FACILITY_TYPES = [
    ("National Hospital", 6, (500, 2000), (200, 1000), 1000, 1),
    ("Regional Hospital", 5, (200, 800), (100, 300), 500, 2),
    ("District Hospital", 4, (100, 200), (50, 150), 200, 3),
    ("Health Center", 3, (20, 100), (10, 50), 50, 5),
    ("Clinic", 2, (5, 20), (5, 20), 10, 8),
    ("Dispensary", 1, (1, 5), (2, 10), 0, 10),
]
URBAN_TYPE_WEIGHT_FACTOR = 3          # for levels <= 3 in urban geographies
URBAN_TYPE_MAX_LEVEL = 3
FALLBACK_TYPES = ["Health Center", "Clinic", "Dispensary"]

# --- fixed values: effective ranges by level as generated
#     (min level, capacity [lo, hi), staff [lo, hi), ambulances [lo, hi)) -----
LEVEL_RANGES = [
    (5, (500, 2000), (200, 1000), (5, 20)),
    (4, (200, 800), (100, 300), (2, 10)),
    (1, (5, 100), (5, 50), (0, 3)),
]
FULL_SERVICE_MIN_LEVEL = 4            # lab, isolation ward and X-ray
FACILITY_OFFSET_DEG = 0.05
ESTABLISHED_YEAR_RANGE = (1990, 2024)
OPERATIONAL_STATUS = [("Operational", 0.85), ("Under Construction", 0.10), ("Closed", 0.05)]
URBAN_ALLOCATION_FACTOR = 2
DEFAULT_TOTAL_FACILITIES = 500
DEFAULT_TOTAL_DISTRICTS = 30

# --- fixed values: climate by country (rainy months, base rainfall) ----------
CLIMATE = [
    ("KE", [3, 4, 5, 10, 11], 80),
    ("NG", [4, 5, 6, 7, 8, 9], 120),
    ("ZA", [11, 12, 1, 2, 3], 100),
]
DEFAULT_BASE_RAINFALL = 50
COASTAL_WORDS = ["coast", "lagos", "Eastern Cape", "KwaZulu-Natal", "Northern Cape", "Western Cape"]
WET_DAY_PROB = {"rainy": 0.6, "dry": 0.15}
RAIN_CAP = {"rainy": 200, "dry": 50}
HUMIDITY_BASE = {"rainy": 70, "dry": 50}
HUMIDITY_WET_ADD = (10, 30)
HUMIDITY_DRY_SUB = (5, 15)
HUMIDITY_RANGE = (20, 100)
TEMP_SPAN_RANGE = (5, 12)
TEMP_BASE = 30
TEMP_LAT_DIVISOR = 3
TEMP_SWING = {"coastal": 5, "inland": 10}
TEMP_NOISE_SD = 2.0

# --- fixed values: disease rules ----------------------------------------------
DISEASES = ["Malaria", "Cholera", "Tuberculosis"]
MALARIA_BASE = {"urban": 0.5, "rural": 2.0}
MALARIA_SEASON_MONTHS = [3, 4, 5, 10, 11]
MALARIA_SEASON = {"in": 2.5, "out": 0.5}
MALARIA_HISTORY_DAYS = 21
MALARIA_RAIN_DIVISOR = 500
TEMP_BANDS = [((25, 30), 1.5), ((20, 35), 1.0)]
TEMP_BAND_DEFAULT = 0.5
CHOLERA_OUTBREAK_BASE = {"urban": 5.0, "rural": 3.0}
OUTBREAK_PEAK_DAY = 18
OUTBREAK_WIDTH_DAYS = 10
OUTBREAK_ACTIVE_DAYS = 60
OUTBREAK_TRIGGER_RAIN = 80
OUTBREAK_INTENSITY_RANGE = (1.5, 3.0)
CHOLERA_ALERT_RAIN = 50
TB_BASE = {"urban": 0.8, "rural": 0.5}
TB_SEASON_MONTHS = [6, 7, 8]
TB_SEASON = {"in": 1.2, "out": 1.0}
PER_POPULATION = 100_000
CASE_FATALITY = [("Malaria", 0.02), ("Cholera", 0.05), ("Tuberculosis", 0.01)]
AGE_GROUPS = ["0-5", "6-17", "18-49", "50-64", "65+"]
AGE_WEIGHTS = {
    "Malaria": [0.4, 0.2, 0.2, 0.1, 0.1],
    "Cholera": [0.20, 0.20, 0.20, 0.20, 0.20],
    "Tuberculosis": [0.1, 0.2, 0.5, 0.1, 0.1],
}
GENDERS = ["M", "F"]
MALE_SHARE = 0.47
MAX_REPORT_DELAY_DAYS = 14
URBAN_RURAL = ["Urban", "Rural"]
