"""Vocabularies that results depend on."""

# Section banners and the species that they stand for; the first that fits counts.
BANNERS = [
    ("SOUTHERN RESIDENTS", "southern_resident"),
    ("NORTHERN RESIDENT KILLER WHALES", "northern_resident"),
    ("NORTHERN RESIDENTS", "northern_resident"),
    ("BIGG'S KILLER WHALES", "biggs"),
    ("UNIDENTIFIED KILLER WHALES", "unidentified_orca"),
    ("GRAY WHALES", "gray"),
    ("HUMPBACK WHALES", "humpback"),
    ("MINKE WHALES", "minke"),
    ("DOLPHINS", "other"),
    ("UNIDENTIFIED BALEEN WHALES", "unidentified_baleen"),
    ("UNIDENTIFIED SPECIES", "other"),
]

# key, label, whether an orca
SPECIES = [
    ("southern_resident", "Southern Resident", True),
    ("northern_resident", "Northern Resident", True),
    ("biggs", "Bigg's", True),
    ("unidentified_orca", "Unidentified Orca", True),
    ("gray", "Gray Whale", False),
    ("humpback", "Humpback", False),
    ("minke", "Minke", False),
    ("unidentified_baleen", "Unidentified Baleen", False),
    ("other", "Other", False),
]

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DETECTION_METHODS = ["visual", "hydrophone", "webcam"]
REPORT_KINDS = ["header_summary", "timestamped", "form_submission"]
CONFIDENCES = ["high", "medium", "low", "none"]

# Landmark classes that may resolve a position, and those that are published.
WATER_CLASSES = ["Bay", "Cape", "Island", "Bar", "Beach", "Cliff", "Pillar", "Gut", "Channel", "Sea"]
PUBLIC_CLASSES = ["Bay", "Channel", "Island", "Cape", "Beach", "Bar", "Cliff", "Pillar", "Gut", "Buoy"]
IMPORT_CLASSES = [*WATER_CLASSES, "Populated Place"]

# Zoom from which a class is labelled.
LABEL_ZOOM = [("Bay", 9), ("Channel", 9), ("Island", 11), ("Cape", 11), ("Beach", 13), ("Bar", 13), ("Cliff", 13), ("Pillar", 13), ("Gut", 13), ("Verified", 10)]

# Names of real places that are ordinary words too; they anchor nothing.
GENERIC_NAMES = ["beach", "cove", "home", "summit", "bayview", "view", "south end", "north end", "sunset", "shoreline", "clipper", "triton", "agate", "victor"]

MAX_CHUNK = 12_000
BATCH = 60
MOST_ANCHORS, MOST_BATCH_ANCHORS, SHORTEST_ANCHOR = 6, 40, 4

# Prices in dollars a token (in, out) by stage, and rates of the cost projection.
PRICES = {"extract": (3e-6, 15e-6), "geocode": (4e-6, 20e-6)}
OUT_PER_SEPARATOR, STRINGS_PER_SEPARATOR, GEO_IN, GEO_OUT, CALLS_PER_BATCH = 343, 1.04, 240, 270, 1.2

# Farthest inland, in metres, that an answer is asked for again; beyond, the water areas do not cover it.
MOST_INLAND = 5_000

# Verified entries that are no places, which are not published.
UNPUBLISHED = ["Lime Kiln webcam", "north side of Jones Island", "Ruston shore"]

# Water areas that are imported, by their names.
WATER_AREAS = ["5", "6", "7", "8-1", "8-2", "9", "10", "11", "12", "13"]

# name, lat, lng
HYDROPHONES = [
    ("Orcasound Lab", 48.5583362, -123.1735774),
    ("North San Juan Channel", 48.591294, -123.058779),
    ("Andrews Bay", 48.546653, -123.166408),
    ("Port Townsend", 48.135743, -122.760614),
    ("Bush Point", 48.0336664, -122.6040035),
    ("Beach Camp at Sunset Bay", 47.86497296593844, -122.33393605795372),
    ("Point Robinson", 47.388383, -122.37267),
    ("MaST Center Aquarium", 47.34922, -122.32512),
]
WEBCAMS = [("Lime Kiln Lighthouse", 48.5158709, -123.1524506, "west")]

# name, aliases, lat, lng, region
SEED_PLACES = [
    ("Bush Point", [], 48.0330, -122.6120, "Admiralty Inlet"),
    ("Lime Kiln Point", ["Lime Kiln", "Lime Kiln State Park"], 48.5160, -123.1550, "Haro Strait"),
    ("Sandy Point", ["Sandy Point, Whidbey"], 48.0520, -122.3770, "Saratoga Passage"),
    ("Possession Point", [], 47.9020, -122.3830, "Possession Sound"),
    ("Alki Point", ["Alki"], 47.5765, -122.4230, "Puget Sound"),
    ("Point No Point", [], 47.9125, -122.5220, "Admiralty Inlet"),
    ("Edmonds Ferry Dock", ["Edmonds ferry", "Edmonds"], 47.8130, -122.3860, "Puget Sound"),
    ("Langley", ["Langley, Whidbey"], 48.0420, -122.4030, "Saratoga Passage"),
    ("East Point (Whidbey)", ["East Point"], 48.0900, -122.3500, "Saratoga Passage"),
    ("Olalla Bay", ["Olalla"], 47.4265, -122.5430, "Colvos Passage"),
]
