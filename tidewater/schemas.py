"""Tables of the message archive as Spark DDL, and the orders of its enumerations."""

MESSAGES = (
    "source string, raw_ts bigint, coarse_ts bigint, kind string, body string, mentions array<struct<start:int,length:int,uuid:string>>, quote_author string, quote_text string, "
    "attachment_count int, target_ts bigint, retracted boolean, superseded_by bigint, processed_window string"
)
MUTATIONS = "source string, target_ts bigint, kind string, by_ts bigint, arrival bigint"
EVIDENCE = "array<struct<url:string,quote:string,confidence:string>>"
RECORDS = (
    "title string, topic_key string, question string, answer string, confidence string, research_status string, finding string, headline string, "
    f"evidence {EVIDENCE}, contradictions array<string>, open_questions array<string>, tags array<string>"
)
TOPICS = RECORDS + ", stem string, first_raised string, last_verified string, updates array<struct<date:string,headline:string,changes:array<string>,sources:array<string>>>, content_sha string, managed boolean"
TASKS = (
    "window_id string, seq int, question string, in_scope boolean, worth double, difficulty string, duplicate_of string, topic_key string, new_information string, urls array<string>, rationale string"
)

# Strongest first, what sticks first, and the order of reading.
CONFIDENCE_ORDER = ("primary", "corroborated", "single-source", "unverified")
STATUS_ORDER = ("dropped", "contested", "answered", "researching", "open")
DISPLAY_ORDER = ("contested", "open", "researching", "answered", "dropped")
FINDING_ORDER = ("refuted", "mixed", "supported", "unestablished")

BUCKET_MS = 900_000
