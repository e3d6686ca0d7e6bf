"""Fixed values of the collection format.

The tables in this module are fixed values: ids, names and bounds that files in
the unified query / candidate format already carry.
"""

# Dataset name -> dataset id.
DATASET_IDS = {
    "VisualNews": 0,
    "Fashion200K": 1,
    "WebQA": 2,
    "EDIS": 3,
    "NIGHTS": 4,
    "OVEN": 5,
    "INFOSEEK": 6,
    "FashionIQ": 7,
    "CIRR": 8,
    "MSCOCO": 9,
    "FLICKR30K": 10,
}

# Dataset name -> domain.
DATASET_DOMAINS = {
    "VisualNews": "news",
    "Fashion200K": "fashion",
    "WebQA": "wiki",
    "EDIS": "news",
    "NIGHTS": "common",
    "OVEN": "wiki",
    "INFOSEEK": "wiki",
    "FashionIQ": "fashion",
    "CIRR": "common",
    "MSCOCO": "common",
    "FLICKR30K": "common",
}

# Fixed values: "query modality -> candidate modality" -> task id.  Task 5 is
# declared but no collection uses it.
TASK_IDS = {
    "text -> image": 0,
    "text -> text": 1,
    "text -> image,text": 2,
    "image -> text": 3,
    "image -> image": 4,
    "image -> text,image": 5,
    "image,text -> text": 6,
    "image,text -> image": 7,
    "image,text -> image,text": 8,
}

# Order of datasets in a result table; others come last (99).
RESULT_DATASET_ORDER = {
    "visualnews_task0": 1,
    "mscoco_task0": 2,
    "fashion200k_task0": 3,
    "webqa_task1": 4,
    "edis_task2": 5,
    "webqa_task2": 6,
    "visualnews_task3": 7,
    "mscoco_task3": 8,
    "fashion200k_task3": 9,
    "nights_task4": 10,
    "oven_task6": 11,
    "infoseek_task6": 12,
    "fashioniq_task7": 13,
    "cirr_task7": 14,
    "oven_task8": 15,
    "infoseek_task8": 16,
}
RESULT_SPLIT_ORDER = {"val": 1, "test": 2}
RESULT_POOL_ORDER = {"union": 99}
RESULT_METRICS = ["Recall@1", "Recall@5", "Recall@10", "Recall@20", "Recall@50"]
ERROR_METRICS = ["Type1", "Type2", "Type3"]

# Pools whose files carry a "_test" suffix.
TEST_SUFFIX_POOLS = ["mscoco_task0", "mscoco_task3", "flickr30k_task0", "flickr30k_task3"]

# How many local ids one dataset may use in a packed id.
QUERY_ID_BOUND = 500_000
CANDIDATE_ID_BOUND = 10_000_000

# Modalities and the code of a modality (first code position).
TEXT = "text"
IMAGE = "image"
IMAGE_TEXT = "image,text"
MODALITY_CODES = {IMAGE: 0, TEXT: 1, IMAGE_TEXT: 2}

# Defaults of the reported configuration.
CHUNK_WORDS = 100
CODE_LEVELS = 8
CODE_VOCABULARY = 4096
BEAMS = 50
METER_WINDOW = 20
