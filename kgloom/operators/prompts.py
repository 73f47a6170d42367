"""Prompt grids: one question for each entity, language and property, and their chat layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fill, label, one_line, split_prompt

PROPERTIES = {"pob": "P19", "dob": "P569", "occ": "P106", "country": "P27"}
_RULE = {
    "en": ("Answer with {what} only, in English{form}.", "{question}"),
    "fr": ("Réponds uniquement par {what}, en français{form}.", "{question}"),
    "de": ("Antworte nur mit {what}, auf Deutsch{form}.", "{question}"),
    "ru": ("Ответь только так: {what}, по-русски{form}.", "{question}"),
    "it": ("Rispondi soltanto con {what}, in italiano{form}.", "{question}"),
    "ar": ("أجب فقط بـ{what} باللغة العربية{form}.", "{question}"),
    "pl": ("Odpowiedz tylko: {what}, po polsku{form}.", "{question}"),
    "zh": ("只用中文回答{what}{form}。", "{question}"),
    "hi": ("केवल {what} हिन्दी में लिखें{form}।", "{question}"),
}
#: By language: what is asked for and the question, for place and date of birth, occupation and country; a worked example.
_ASK = {
    "en": (("the place", "Where was {} born?"), ("the date", "When was {} born?"), ("the occupation", "What is the occupation of {}?"), ("the country", "Which country is {} a citizen of?"), "Example: Ada Nowak - [Poland]"),
    "fr": (("le lieu", "Où {} est-il né ou est-elle née ?"), ("la date", "Quelle est la date de naissance de {} ?"), ("le métier", "Quel est le métier de {} ?"), ("le pays", "De quel pays {} a-t-il ou a-t-elle la nationalité ?"), "Exemple : Ada Nowak - [Pologne]"),
    "de": (("dem Ort", "Wo wurde {} geboren?"), ("dem Datum", "Wann wurde {} geboren?"), ("dem Beruf", "Welchen Beruf hat {}?"), ("dem Land", "Welche Staatsangehörigkeit hat {}?"), "Beispiel: Ada Nowak - [Polen]"),
    "ru": (("место", "Где место рождения {}?"), ("дата", "Какова дата рождения {}?"), ("профессия", "Какая профессия у {}?"), ("страна", "Какое гражданство у {}?"), "Пример: Ада Новак - [Польша]"),
    "it": (("il luogo", "Qual è il luogo di nascita di {}?"), ("la data", "Qual è la data di nascita di {}?"), ("la professione", "Qual è la professione di {}?"), ("il paese", "Qual è la cittadinanza di {}?"), "Esempio: Ada Nowak - [Polonia]"),
    "ar": (("المكان", "ما مكان ميلاد {}؟"), ("التاريخ", "ما تاريخ ميلاد {}؟"), ("المهنة", "ما مهنة {}؟"), ("البلد", "ما بلد جنسية {}؟"), "مثال: آدا نوفاك - [بولندا]"),
    "pl": (("miejsce", "Jakie jest miejsce urodzenia {}?"), ("data", "Jaka jest data urodzenia {}?"), ("zawód", "Jaki jest zawód {}?"), ("kraj", "Jakie jest obywatelstwo {}?"), "Przykład: Ada Nowak - [Polska]"),
    "zh": (("地点", "{}出生在哪里？"), ("日期", "{}的出生日期是什么？"), ("职业", "{}的职业是什么？"), ("国家", "{}是哪国公民？"), "例：阿达·诺瓦克 - [波兰]"),
    "hi": (("स्थान", "{} का जन्म कहाँ हुआ?"), ("तारीख", "{} की जन्म तिथि क्या है?"), ("पेशा", "{} का पेशा क्या है?"), ("देश", "{} किस देश के नागरिक हैं?"), "उदाहरण: एडा नोवाक - [पोलैंड]"),
}


def templates() -> list[tuple[str, str, str]]:
    """(lang, property, template) for every language and property; ``##`` begins each part."""
    out = []
    for lang, (*asks, example) in _ASK.items():
        rule, _ = _RULE[lang]
        for prop, (what, question) in zip(PROPERTIES, asks, strict=True):
            form = " (YYYY-MM-DD)" if prop == "dob" else ""
            parts = [rule.format(what=what, form=form), question] + ([example] if prop == "country" else [])
            out.append((lang, prop, "".join(f"## {p} " for p in parts).strip()))
    return out


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(templates(), "lang string, property string, template string")


def grid(entities: DataFrame, templates: DataFrame, languages: list[str], properties: dict[str, str] = PROPERTIES) -> DataFrame:
    """Entities (qid, labels, props, sitelinks) -> (ent_ID, lang, property, ground_truth array, prompt, num_sitelinks).

    An entity's name falls back to English, and without either it has no rows. A prompt is empty where no value has a
    label in the language; the date of birth is the first value as it stands, and always asked for.
    """
    each = entities.select("qid", "labels", "props", "sitelinks", F.explode(F.array(*map(F.lit, languages))).alias("lang")).withColumn("_name", label("labels", "lang")).where("_name is not null")
    want = F.explode(F.array(*(F.struct(F.lit(n).alias("property"), F.lit(p).alias("_p")) for n, p in properties.items()))).alias("w")
    each = each.select("*", want).select("*", "w.property", "w._p").drop("w")
    held = F.try_element_at("props", "_p")["values"]
    labelled = F.filter(F.transform(held, lambda v: F.try_element_at(v["labels"], F.col("lang"))), lambda x: x.isNotNull())
    first = F.filter(F.slice(F.transform(held, lambda v: v["value"]), 1, 1), lambda x: x.isNotNull())
    truth = F.coalesce(F.when(F.col("property") == "dob", first).otherwise(labelled), F.array().cast("array<string>"))
    out = each.withColumn("ground_truth", truth).join(F.broadcast(templates), ["lang", "property"], "left")
    prompt = F.when(F.size("ground_truth") > 0, fill("template", "_name")).otherwise("")
    return out.select(F.col("qid").alias("ent_ID"), "lang", "property", "ground_truth", prompt.alias("prompt"), F.col("sitelinks").alias("num_sitelinks"))


def wide(grid_: DataFrame) -> DataFrame:
    """One row for each entity and language, with <property>_ground_truth and <property>_prompt; most linked first."""
    out = grid_.groupBy("ent_ID", "lang", "num_sitelinks").pivot("property", list(PROPERTIES)).agg(F.first("ground_truth").alias("ground_truth"), F.first("prompt").alias("prompt"))
    return out.orderBy(F.desc("num_sitelinks"), "ent_ID", "lang")


def samples(wide_: DataFrame, LoE: Column | str, properties: list[str] | None = None) -> DataFrame:
    """Wide rows (ent_ID, lang, <p>_prompt, <p>_ground_truth ...) -> (Q_number, LoE, property, LoQ, gt, instruction, question); empty prompts go."""
    found = sorted(c.removesuffix("_prompt") for c in wide_.columns if c.endswith("_prompt"))
    missing = [p for p in found if f"{p}_ground_truth" not in wide_.columns]
    if missing:
        raise ValueError(f"no ground truth column for {missing}")
    found = [p for p in found if properties is None or p in properties]
    text = lambda p: F.col(f"{p}_ground_truth").cast("string") if dict(wide_.dtypes)[f"{p}_ground_truth"] == "string" else F.to_json(f"{p}_ground_truth")
    rows = F.inline(F.array(*(F.struct(F.lit(p).alias("property"), text(p).alias("gt"), F.col(f"{p}_prompt").alias("_prompt")) for p in found)))
    out = wide_.select(F.col("ent_ID").alias("Q_number"), (F.col(LoE) if isinstance(LoE, str) else LoE).alias("LoE"), F.col("lang").alias("LoQ"), rows).where(F.length("_prompt") > 0)
    return out.withColumn("_s", split_prompt("_prompt")).select("Q_number", "LoE", "property", "LoQ", "gt", "_s.instruction", "_s.question")


#: How model families take a prompt. Two messages, a mark that turns thinking off, one message, or one of typed parts.
LAYOUTS = {
    "system": ("microsoft/phi-4", "meta-llama/Meta-Llama-3.1-8B-Instruct", "Qwen/Qwen3-8B", "Qwen/Qwen3-14B", "zai-org/glm-4-9b-chat-hf", "allenai/Olmo-3-7B-Instruct", "moonshotai/Moonlight-16B-A3B-Instruct"),
    "no_think": ("nvidia/NVIDIA-Nemotron-Nano-9B-v2",),
    "user": ("deepseek-ai/DeepSeek-V2-Lite-Chat", "mistralai/Mistral-7B-Instruct-v0.3", "google/gemma-2-9b-it"),
    "typed": ("google/gemma-3-12b-it",),
}
#: Decoding; most models share the first, the others differ from it.
DECODING = {"max_new_tokens": 128, "do_sample": True, "temperature": 0.6}
DECODING_OF = {
    "meta-llama/Meta-Llama-3.1-8B-Instruct": {"top_p": 0.9, "stop_tokens": ["eos", "<|eot_id|>"]},
    "microsoft/phi-4": {"eos_token_id": [100257, 100265]},
    "deepseek-ai/DeepSeek-V2-Lite-Chat": {"max_new_tokens": 1024},
}


def layout_of(model: str) -> str:
    for layout, models in LAYOUTS.items():
        if model in models:
            return layout
    raise ValueError(f"unknown model: {model}")


def decoding(model: str) -> dict:
    layout_of(model)
    return DECODING | DECODING_OF.get(model, {})


def chat(layout: Column | str) -> Column:
    """array<struct<role, content>> of instruction and question by the layout's name; typed parts are JSON."""
    layout = F.col(layout) if isinstance(layout, str) else layout
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    both = F.concat("instruction", "question")
    return (
        F.when(layout == "system", F.array(say("system", F.col("instruction")), say("user", F.col("question"))))
        .when(layout == "no_think", F.array(say("system", F.lit("/no_think")), say("user", both)))
        .when(layout == "user", F.array(say("user", both)))
        .when(layout == "typed", F.array(say("user", F.to_json(F.array(F.struct(F.lit("text").alias("type"), both.alias("text")))))))
        .otherwise(F.raise_error(F.concat(F.lit("unknown layout: "), layout)).cast("array<struct<role:string,content:string>>"))
    )


def answers(samples_: DataFrame, output: Column | str) -> DataFrame:
    """Answer rows: keys, truth, the model's output, and the prompt in one line."""
    return samples_.select("Q_number", "LoE", "LoQ", "property", "gt", (F.col(output) if isinstance(output, str) else output).alias("llm_output"), one_line(F.concat("instruction", "question")).alias("prompt"))
