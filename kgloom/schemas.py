"""Row types of the tables that operators take and give."""

from __future__ import annotations

# Fixed values below: the columns of the exchanged files.
TRIPLES = "s string, p string, o string"
LABELS = "entity string, kind string, lang string, value string"
VALUE = "struct<value:string,value_id:string,labels:map<string,string>,labels_count:int>"
ENTITIES = f"qid string, labels map<string,string>, props map<string,struct<values:array<{VALUE}>,count:int>>, labels_count int, sitelinks int"
#: One entity as its JSON file has it: a property's values carry the id under qid.
ENTITY_JSON = "struct<labels:map<string,string>,labels_count:int,sitelinks:int>"
PROPERTY_JSON = "struct<values:array<struct<qid:string,labels:map<string,string>,labels_count:int>>,count:int>"
BINDINGS = "array<map<string,struct<value:string>>>"
PROMPTS = ", ".join(["ent_ID string", "lang string", "pob_ground_truth array<string>", "pob_prompt string", "dob_ground_truth string", "dob_prompt string", "occ_ground_truth array<string>", "occ_prompt string", "country_ground_truth array<string>", "country_prompt string", "num_sitelinks int"])
ANSWERS = ", ".join(f"{c} string" for c in ("Q_number", "LoE", "LoQ", "property", "gt", "llm_output", "prompt"))
GRADED = ANSWERS + ", llm_output_en string, eval string, eval_type string, provenance string"
VOCAB = "country_q string, lang string, kind string, value string"
CITIZENSHIP = "entity_q string, country_q string"
PLACES = "name_key string, q string, countries array<string>"
TRANSLATIONS = "loq string, text string, en string, pos long"
VERDICTS = "llm_output string, gt_raw string, match_type string"

#: Languages, what the harvest asks for, and which properties matter where.
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "ru": "Russian", "it": "Italian", "ar": "Arabic", "pl": "Polish", "zh": "Chinese", "hi": "Hindi"}
#: Ids of each language with its variants, as entities name what they speak.
LANGUAGE_IDS = {
    "English": ("Q1860", "Q7976", "Q7979", "Q44676", "Q44679", "Q7053766", "Q48767245"),
    "Arabic": ("Q13955", "Q29919", "Q56499", "Q1194795", "Q1654327", "Q5329979"),
    "German": ("Q188", "Q248682", "Q306626", "Q106937689", "Q26721", "Q387066"),
    "French": ("Q150", "Q1450506", "Q214086", "Q3083193", "Q979914", "Q83503"),
    "Italian": ("Q652",),
    "Polish": ("Q809",),
    "Hindi": ("Q1568",),
    "Russian": ("Q7737", "Q608923"),
    "Spanish": ("Q1321",),
    "Chinese": ("Q7850", "Q24841726", "Q13414913", "Q18130932", "Q100148307"),
}
COMPLETE = ("P20", "P19", "P106", "P27")
LEAST_LINKS, BIN_WIDTH, SEED = 9, 5, 42
EXCLUDED = ("P21", "P1412", "P6886")
CLASSES = {"creator": "Q2500638", "politician": "Q82955", "actor": "Q33999", "writer": "Q36180", "artist": "Q483501", "athlete": "Q2066131", "researcher": "Q1650915", "university teacher": "Q1622272", "professor": "Q121594", "author": "Q482980"}
PROPERTIES = {
    "place_of_birth": "P19", "place_of_death": "P20", "place_of_burial": "P119", "cause_of_death": "P509", "residence": "P551", "date_of_birth": "P569", "date_of_death": "P570",
    "father": "P22", "mother": "P25", "spouse": "P26", "child": "P40", "sibling": "P3373", "student_of": "P1066", "doctoral_advisor": "P184",
    "position_held": "P39", "field_of_work": "P101", "occupation": "P106", "employer": "P108", "movement": "P135", "award_received": "P166", "member_of": "P463", "academic_degree": "P512", "notable_work": "P800", "work_location": "P937",
    "cast_member_of": "P161", "character_role": "P453", "voice_actor": "P725",
    "country_of_citizenship": "P27", "educated_at": "P69", "native_language": "P103", "religion": "P140", "ethnic_group": "P172", "member_of_political_party": "P102",
}


def requested(properties: dict[str, str] = PROPERTIES, excluded: tuple[str, ...] = EXCLUDED) -> dict[str, str]:
    """Properties without the excluded ids."""
    return {n: p for n, p in properties.items() if p not in excluded}
