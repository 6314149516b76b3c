"""Names, word lists, patterns and texts that results depend on."""

# --- fixed values: source headers of two generations -> canonical names ------
CANONICAL_COLUMNS = {
    "id": "observation_id",
    "samplingPoint.notation": "site_id",
    "samplingPoint.prefLabel": "site_label",
    "samplingPoint.longitude": "lon",
    "samplingPoint.latitude": "lat",
    "samplingPoint.region": "region",
    "samplingPoint.area": "area",
    "samplingPoint.subArea": "sub_area",
    "samplingPoint.samplingPointStatus": "site_status",
    "samplingPoint.samplingPointType": "site_type",
    "phenomenonTime": "sample_datetime",
    "samplingPurpose": "sampling_purpose",
    "sampleMaterialType": "sample_material",
    "determinand.notation": "determinand_code",
    "determinand.prefLabel": "determinant",
    "unit": "unit",
    "sample.samplingPoint.notation": "site_id",
    "sample.samplingPoint.label": "site_label",
    "sample.samplingPoint.lat": "lat",
    "sample.samplingPoint.long": "lon",
    "sample.sampleDateTime": "sample_datetime",
    "sample.sampledMaterialType.label": "sample_material",
    "determinand.definition": "determinant",
    "determinand.unit.label": "unit",
    "result": "result_raw",
}

# Second pass, used only where the canonical column is absent.
LATE_RENAMES = {
    "determinant_code": "determinand_code",
    "site_name": "site_label",
    "datetime": "sample_dt",
}

REQUIRED_RAW_COLUMNS = (
    "site_id",
    "sample_material",
    "determinand_code",
    "determinant",
    "result_raw",
    "unit",
    "sample_datetime",
)

# --- fixed values: cleaning --------------------------------------------------
ALWAYS_EXCLUDED_UNITS = ("Text Result", "Coded Result", "PRESENT/NOT FOUND", "COLOUR")

ALWAYS_EXCLUDED_DETERMINANDS = (
    "Ionic Balance",
    "Equiv.Carbon No >10-35, Aliphatic Fraction",
    "Equiv.Carbon No >10-20, Aromatic Fraction",
    "Equiv.Carbon No >5-40",
)

EXCLUDED_DETERMINAND_PATTERNS = (r"(?i)\bionic balance\b", r"(?i)equiv\.?\s*carbon")

CLAMPED_DETERMINAND = "Alkalinity to pH 4.5 : Grans Plot"
TEMPERATURE_DETERMINAND = "Temperature of Water"
TEMPERATURE_LIMIT = 45.0

RAW_FILE_PATTERN = r"(?i)obs_area-(\d+)_(\d{4})\.csv$"
SKIPPED_SOURCE_YEARS = (2014,)

# --- fixed values: site columns ----------------------------------------------
SITE_ATTRIBUTES = (
    "site_label",
    "lon",
    "lat",
    "region",
    "area",
    "sub_area",
    "site_type",
    "site_status",
)

COVERAGE_COLUMNS = (
    "first_sample",
    "last_sample",
    "total_observations",
    "distinct_sample_dates",
    "avg_days_between_visits",
)

TYPOLOGY_COLUMNS = (
    "site_id",
    "wfd_type",
    "water_body_id",
    "water_body_name",
    "water_body_type",
    "water_body_hmd",
    "ecological_class",
    "chemical_class",
    "overall_water_body_class",
    "dist_to_wfd_m",
)

NON_FEATURE_COLUMNS = frozenset(
    ("site_id", "site_name", "umap_x", "umap_y", "n_features_present")
    + SITE_ATTRIBUTES
    + COVERAGE_COLUMNS
    + TYPOLOGY_COLUMNS
)
GENERATED_PREFIXES = ("is_", "flag_")
GENERATED_SUFFIXES = ("_z", "_rank", "_score", "_distance", "_overlap")

# --- fixed values: incidents -------------------------------------------------
WATER_IMPACT_CATEGORIES = (
    "Category 1 (Major)",
    "Category 2 (Significant)",
    "Category 3 (Minor)",
)

RELEVANT_POLLUTANT_TYPES = (
    "Sewage Materials",
    "Agricultural Materials and Wastes",
    "Oils and Fuel",
    "Organic Chemicals/Products",
    "Inorganic Chemicals/Products",
    "Contaminated Water",
)

RELEVANT_POLLUTANTS = (
    "Crude Sewage", "Storm Sewage", "Sludge", "Final Effluent",
    "Grey Water", "Other Sewage Material", "Backwash Effluent",
    "Slurry and Dilute Slurry", "Solid Manure", "Silage Liquors",
    "Dairy Washings", "Other Agricultural Material or Waste",
    "Fertiliser", "Blood and Offal", "Carcasses",
    "Other Animal Matter", "Vegetable Washings", "Vegetable Cuttings and Deposits",
    "Diesel", "Petrol", "Gas and Fuel Oils", "Crude Oil",
    "Kerosene and Aviation Fuel", "Unidentified Oil", "Mixed/Waste Oils",
    "Other Oil or Fuel", "Lubricating Oils", "Hydraulic Oils",
    "Cutting Oils", "Insulating and Cable Oils",
    "Paints and Varnishes", "Solvents", "Dyes and Inks",
    "Surfactants and Detergents", "Phenols and Creosote",
    "Pesticides and Biocides", "Sheep Dip",
    "Heavy Metals", "Acids", "Alkalis", "Cyanides", "Ammonia Solutions",
    "Chemically Contaminated Run-Off", "Other Contaminated Water",
    "Other Inorganic Chemical or Product", "Other Organic Chemical or Product",
    "Inorganic Chemical Wastes", "Organic Chemical Wastes",
    "Landfill Leachate", "Minewater", "Process Effluent",
    "Firefighting Run-Off", "Urban Run-Off",
    "Algae", "Natural Organic Material",
    "Effect on Animals", "Microbiological",
    "Suspended Solids",
)

OUT_OF_SCOPE_POLLUTANTS = (
    "Noise", "Smoke", "Fumes", "Dust", "Steam",
    "Soot/Smuts", "Chemical Odour", "Ammonia/Amine Odour",
    "Sulphide Odour", "Landfill Odour", "Other Odour",
    "Other Atmospheric Pollutant or Effect",
    "Damage to Buildings, Vehicles and Vegetation",
    "Effects on Humans", "Flies", "Vermin",
    "Asbestos", "Batteries", "Electrical Equipment",
    "Tyres", "Vehicles and Vehicle Parts", "Containers",
    "Clinical Waste", "Prescription only medicines",
    "Radionucleid",
)

# --- fixed values: overflow return headers (target -> header fragments) ------
OVERFLOW_HEADERS = {
    "unique_id": ("unique id", "unique_id"),
    "water_company": ("water company name", "water_company_name", "company name"),
    "site_name": ("site name",),
    "permit_ref": ("ea permit ref", "permit ref", "ea_permit_ref"),
    "asset_type": ("storm discharge asset type", "asset type", "storm_discharge_asset"),
    "outlet_ngr": ("outlet discharge ngr", "ngr"),
    "waterbody_id": ("wfd waterbody id", "waterbody_id"),
    "waterbody_name": ("wfd waterbody catchment", "catchment name"),
    "receiving_water": ("receiving water", "receiving environment"),
    "spill_count": ("counted spills", "spill count"),
    "total_duration": ("total duration",),
}

# --- fixed values: discharge codes -------------------------------------------
SEWAGE_CODES = ("SA", "SB", "SC", "SD", "SE", "UA", "UB", "UC", "UD", "UE")
STORM_OVERFLOW_CODES = ("SB", "SC", "UB", "UC")
INDUSTRIAL_CODES = ("TA", "TB", "TC", "TD", "TE", "TF", "TG")

# --- fixed values: national grid squares (letters -> 100 km column, row) -----
GRID_SQUARES = {
    "SV": (0, 0), "SW": (1, 0), "SX": (2, 0), "SY": (3, 0), "SZ": (4, 0), "TV": (5, 0), "TW": (6, 0),
    "SQ": (0, 1), "SR": (1, 1), "SS": (2, 1), "ST": (3, 1), "SU": (4, 1), "TQ": (5, 1), "TR": (6, 1),
    "SL": (0, 2), "SM": (1, 2), "SN": (2, 2), "SO": (3, 2), "SP": (4, 2), "TL": (5, 2), "TM": (6, 2),
    "SF": (0, 3), "SG": (1, 3), "SH": (2, 3), "SJ": (3, 3), "SK": (4, 3), "TF": (5, 3), "TG": (6, 3),
    "SA": (0, 4), "SB": (1, 4), "SC": (2, 4), "SD": (3, 4), "SE": (4, 4), "TA": (5, 4), "TB": (6, 4),
    "HV": (0, 5), "HW": (1, 5), "HX": (2, 5), "HY": (3, 5), "HZ": (4, 5), "NV": (5, 5), "NW": (6, 5),
    "HQ": (0, 6), "HR": (1, 6), "HS": (2, 6), "HT": (3, 6), "HU": (4, 6), "NQ": (5, 6), "NR": (6, 6),
    "HL": (0, 7), "HM": (1, 7), "HN": (2, 7), "HO": (3, 7), "HP": (4, 7), "NL": (5, 7), "NM": (6, 7),
    "NA": (0, 8), "NB": (1, 8), "NC": (2, 8), "ND": (3, 8), "NE": (4, 8),
    "NF": (0, 9), "NG": (1, 9), "NH": (2, 9), "NJ": (3, 9), "NK": (4, 9),
    "NY": (3, 5), "NZ": (4, 5), "NT": (3, 6), "NU": (4, 6), "NO": (3, 7), "NP": (4, 7),
    "NS": (2, 6), "NN": (2, 7), "NX": (2, 5),
    "OV": (7, 5),
}

# --- fixed values: squares that go with the linear approximation (letters -> column, row) ---
LINEAR_SQUARES = {
    "SV": (0, 0), "SW": (1, 0), "SX": (2, 0), "SY": (3, 0), "SZ": (4, 0), "TV": (5, 0), "TW": (6, 0),
    "SR": (1, 1), "SS": (2, 1), "ST": (3, 1), "SU": (4, 1),
    "SP": (4, 2), "TL": (5, 2), "TM": (6, 2), "SO": (3, 2), "SN": (2, 2), "SM": (1, 2),
    "SK": (4, 3), "TF": (5, 3), "TG": (6, 3), "SJ": (3, 3), "SH": (2, 3), "SG": (1, 3),
    "SE": (4, 4), "TA": (5, 4), "SD": (3, 4), "SC": (2, 4), "SB": (1, 4),
    "NZ": (4, 5), "OV": (5, 5), "NY": (3, 5), "NX": (2, 5), "NW": (1, 5),
    "NT": (4, 6), "NU": (5, 6), "NS": (3, 6), "NR": (2, 6), "NQ": (1, 6),
    "NN": (3, 7), "NO": (4, 7), "NM": (2, 7), "NL": (1, 7),
    "NH": (2, 8), "NJ": (3, 8), "NK": (4, 8), "NG": (1, 8), "NF": (0, 8),
    "NC": (2, 9), "ND": (3, 9), "NB": (1, 9), "NA": (0, 9),
    "HW": (1, 10), "HX": (2, 10), "HY": (3, 10), "HZ": (4, 10), "HP": (4, 11), "HT": (3, 11), "HU": (4, 11),
}

# --- fixed values: earth radii (metres, kilometres) --------------------------
EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_PRECISE_KM = 6371.0088

# --- fixed values: linear grid approximation ---------------------------------
LINEAR_ORIGIN_LAT = 49.0
LINEAR_ORIGIN_LON = -8.0
LINEAR_METRES_PER_DEGREE = 111_000.0
LINEAR_LON_FACTOR = 0.6

# --- fixed values: quality gates ---------------------------------------------
GATE_COLUMNS = ("site_id", "lat", "lon", "determinand_code", "value")
FEED_REQUIRED_FIELDS = (
    "site_id",
    "site_label",
    "lat",
    "lon",
    "anomaly_rank",
    "anomaly_score",
    "is_flagged",
)
FEED_FLAGGED_FIELDS = ("drivers", "summary")
FIRST_RUN_ROW_FLOOR = 5_000_000

# --- fixed values: keys of the published incident struct ---------------------
INCIDENT_KEYS = (
    "total_pollution_incidents",
    "most_recent_pollution_date",
    "primary_pollution_cause",
    "total_edm_spills",
    "total_spill_hours",
    "most_recent_spill_date",
    "has_any_incidents",
    "total_all_incidents",
)

# --- fixed values: severity and coverage bands -------------------------------
SEVERITY_BANDS = ((8.0, "Extreme"), (4.0, "High"), (1.65, "Moderate"))
SEVERITY_LOWEST = "Lower"
SEVERITY_COLOURS = {
    "Extreme": "#991b1b",
    "High": "#dc2626",
    "Moderate": "#d97706",
    "Lower": "#15803d",
}
SEVERITY_LABELS = {
    "Extreme": "Very unusual",
    "High": "Unusual",
    "Moderate": "Some differences",
    "Lower": "Similar to others",
}
SEVERITY_DESCRIPTIONS = {
    "Extreme": "Readings are very different from similar rivers",
    "High": "Readings are noticeably different from similar rivers",
    "Moderate": "Some readings differ from similar rivers",
    "Lower": "Readings are similar to comparable rivers",
}
FREQUENCY_BANDS = (
    (14, "fortnightly sampling"),
    (45, "monthly sampling"),
    (120, "quarterly sampling"),
    (270, "twice-yearly sampling"),
    (450, "annual sampling"),
)
FREQUENCY_LOWEST = "infrequent sampling"
EVIDENCE_BANDS = ((800, "strong"), (400, "good"), (200, "moderate"))
EVIDENCE_LOWEST = "thin"
NATIONAL_OBSERVATION_MEDIAN = 411

# --- fixed values: typology words --------------------------------------------
TYPOLOGY_WORDS = {
    "Low": "lowland altitude",
    "Mid": "mid-altitude",
    "High": "upland altitude",
    "Small": "small river size",
    "Medium": "medium river size",
    "Large": "large river size",
    "Extra Small": "very small river size",
    "Calcareous": "chalk or limestone geology",
    "Siliceous": "sandstone or granite geology",
    "Organic": "peat or organic soil geology",
    "Salt": "salt-influenced geology",
}

# --- fixed values: words kept lower-case in names ----------------------------
DISPLAY_SMALL_WORDS = ("Of", "The", "At", "On", "In", "To", "And")
TITLE_SMALL_WORDS = ("and", "as", "at", "by", "for", "in", "of", "on", "the", "to")

# --- fixed values: public chemical labels (replaced in this order) -----------
PUBLIC_LABELS = (
    ("Alkalinity to pH 4.5 as CaCO3", "Alkalinity"),
    ("Conductivity at 25 C", "Conductivity"),
    ("Oxygen, Dissolved, % Saturation", "Oxygen saturation"),
    ("Oxygen, Dissolved as O2", "Dissolved oxygen"),
    ("Orthophosphate, reactive as P", "Phosphate"),
    ("Nitrogen, Total Oxidised as N", "Oxidised nitrogen"),
    ("Ammoniacal Nitrogen as N", "Ammonia-related nitrogen"),
    ("Ammonia un-ionised as N", "Toxic ammonia"),
    ("Temperature of Water", "Temperature"),
)

# --- fixed values: determinand context (name, label, high, low, unit) --------
DETERMINAND_CONTEXT = (
    (
        "Temperature of Water",
        "water temperature",
        "elevated water temperature, which can reduce oxygen availability and stress temperature-sensitive aquatic life",
        "unusually low water temperature for its peer group",
        "deg C",
    ),
    (
        "pH",
        "pH",
        "elevated pH, meaning the water is more alkaline than expected and may reflect algal activity, geology, or alkaline inputs",
        "low pH, meaning the water is more acidic than expected and may indicate acidification or acidic inputs",
        "pH units",
    ),
    (
        "Alkalinity to pH 4.5 as CaCO3",
        "alkalinity",
        "high alkalinity, indicating strongly buffered water often associated with chalk or limestone catchments",
        "low alkalinity, meaning the river has limited buffering capacity against acid inputs",
        "mg/L as CaCO3",
    ),
    (
        "Conductivity at 25 C",
        "conductivity",
        "high conductivity, suggesting elevated dissolved ions from geology, sewage effluent, road runoff, agriculture, or industrial inputs",
        "unusually low conductivity, typical of softer, less mineralised waters",
        "uS/cm",
    ),
    (
        "Oxygen, Dissolved as O2",
        "dissolved oxygen",
        "unusually high dissolved oxygen, which can occur during strong photosynthesis or algal activity",
        "low dissolved oxygen, which can stress aquatic life and may indicate organic pollution or sewage inputs",
        "mg/L",
    ),
    (
        "Nitrite as N",
        "nitrite",
        "elevated nitrite, a reactive nitrogen form that can be associated with sewage, organic pollution, or incomplete nitrification",
        "very low nitrite relative to comparable sites",
        "mg/L as N",
    ),
    (
        "Nitrate as N",
        "nitrate",
        "elevated nitrate, commonly linked to agricultural fertiliser runoff, land drainage, or sewage treatment inputs",
        "very low nitrate, often seen in less enriched or upland catchments",
        "mg/L as N",
    ),
    (
        "Ammoniacal Nitrogen as N",
        "ammonia-related nitrogen",
        "elevated ammonia-related nitrogen, which can be associated with sewage, slurry, landfill drainage, manure, or other organic waste",
        "very low ammoniacal nitrogen, consistent with limited recent organic pollution pressure",
        "mg/L as N",
    ),
    (
        "Orthophosphate, reactive as P",
        "reactive orthophosphate",
        "elevated reactive phosphate, a key eutrophication pressure often linked to sewage effluent, agriculture, or urban runoff",
        "very low reactive phosphate, suggesting limited phosphorus enrichment",
        "mg/L as P",
    ),
    (
        "Nitrogen, Total Oxidised as N",
        "oxidised nitrogen",
        "elevated total oxidised nitrogen, indicating nitrate/nitrite enrichment often associated with diffuse agricultural or wastewater sources",
        "low total oxidised nitrogen compared with peer sites",
        "mg/L as N",
    ),
    (
        "Ammonia un-ionised as N",
        "toxic ammonia",
        "elevated toxic ammonia, the ammonia form most harmful to fish and river insects",
        "very low un-ionised ammonia relative to comparable sites",
        "mg/L as N",
    ),
    (
        "Oxygen, Dissolved, % Saturation",
        "dissolved oxygen saturation",
        "high oxygen saturation, which can indicate intense photosynthesis or algal activity",
        "low oxygen saturation, which can indicate oxygen stress from organic pollution, slow flow, or high biological demand",
        "% saturation",
    ),
)

# --- fixed values: summary texts ---------------------------------------------
NORMAL_SUMMARY = "Chemistry is consistent with similar rivers. No unusual patterns detected."
CROSS_TYPE_SUMMARY = (
    "This river's water is within the normal range for its type overall. "
    "However, the rivers most chemically similar to it belong to different "
    "river types, which may reflect local conditions at the boundary between "
    "river classifications."
)
NO_DRIVER_SUMMARY = (
    "Unusual chemistry stands out here.\n\n"
    "This river looks different from similar rivers, but no single chemical measure "
    "dominates the result.\n\n"
    "The pattern should be investigated further."
)

# --- fixed values: public headlines by class ---------------------------------
HEADLINES = {
    "ammonia": (
        "High ammonia pollution signals stand out here.\n\n"
        "This river has unusually high ammonia-related readings compared with similar rivers. "
        "These can harm fish, insects, and other river life.\n\n"
        "The pattern may point to sewage, slurry, landfill drainage, or other organic pollution, "
        "so it should be investigated further."
    ),
    "low_oxygen": (
        "Low oxygen signals stand out here.\n\n"
        "This river has unusually low oxygen readings compared with similar rivers. "
        "Low oxygen can harm fish, insects, and other river life.\n\n"
        "The pattern may indicate organic pollution pressure, slow flow, warm water, "
        "or other stress, so it should be investigated further."
    ),
    "nutrients": (
        "High nutrient pollution signals stand out here.\n\n"
        "This river has unusually high nutrient-related readings compared with similar rivers. "
        "These can feed algal growth and put pressure on river life.\n\n"
        "The pattern may indicate sewage, farm runoff, or other nutrient pollution, "
        "so it should be investigated further."
    ),
    "conductivity": (
        "High dissolved minerals stand out here.\n\n"
        "This river has unusually high conductivity compared with similar rivers. "
        "That means the water contains more dissolved salts and minerals than expected.\n\n"
        "The pattern can be associated with geology, road runoff, wastewater, industry, "
        "or other external inputs, so it should be investigated further."
    ),
    "ph": (
        "Unusual acidity or alkalinity stands out here.\n\n"
        "This river has pH readings that look unusual compared with similar rivers. "
        "Large pH differences can stress fish, insects, and other river life.\n\n"
        "The pattern may reflect natural geology or external inputs, so it should be "
        "investigated further."
    ),
    "temperature": (
        "High water temperature stands out here.\n\n"
        "This river is warmer than expected compared with similar rivers. Warm water can "
        "reduce oxygen availability and stress river wildlife.\n\n"
        "The pattern may reflect weather, low flows, or external pressure, so it should be "
        "investigated further."
    ),
    "other": (
        "Unusual chemistry stands out here.\n\n"
        "This river has readings that differ from similar rivers. That does not prove the cause, "
        "but it shows the site looks out of character.\n\n"
        "The pattern should be investigated further."
    ),
}
