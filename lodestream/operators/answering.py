"""Reading model output: research answers, quizzes and outcome documents; checks of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPPORTUNITY = "struct<layer:string,title:string,description:string,services:array<string>,priority:string>"
ANSWER = f"struct<summary:string,iq_opportunities:array<{OPPORTUNITY}>,recommended_approach:string>"
QUIZ = "struct<questions:array<struct<question:string,options:array<string>,answer:string>>>"
PRIORITIES = ("high", "medium", "low")


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")


def embedded_json(text: Column) -> Column:
    """The text itself if it is a JSON object, else the object in its first fenced block, else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(_is_json(text), text).when(_is_json(fenced), fenced)


def research_answer(df: DataFrame, text: str, approach: str = "See summary.") -> DataFrame:
    """``df`` with summary, opportunities and recommended_approach read from the model's ``text``.

    Text that holds no JSON becomes the summary, with no opportunities and the
    default approach; missing keys get defaults and an unknown priority becomes
    medium.  Null text gives an empty summary.
    """
    a = F.from_json(embedded_json(F.col(text)), ANSWER)
    known = F.transform(
        a["iq_opportunities"],
        lambda o: F.struct(
            o["layer"].alias("layer"), o["title"].alias("title"), F.coalesce(o["description"], F.lit("")).alias("description"),
            F.coalesce(o["services"], F.array().cast("array<string>")).alias("services"), F.when(o["priority"].isin(*PRIORITIES), o["priority"]).otherwise("medium").alias("priority"),
        ),
    )
    plain = embedded_json(F.col(text)).isNull()
    return df.withColumns(
        {
            "summary": F.when(plain, F.coalesce(F.col(text), F.lit(""))).otherwise(F.coalesce(a["summary"], F.lit(""))),
            "opportunities": F.coalesce(known, F.array().cast(f"array<{OPPORTUNITY}>")),
            "recommended_approach": F.coalesce(F.when(~plain, a["recommended_approach"]), F.lit(approach)),
        }
    )


def quiz(text: Column) -> Column:
    """Questions of the outermost object that names them; an empty array if there is none."""
    whole = F.regexp_extract(text, r'(?s)(\{.*"questions".*\})', 1)
    return F.coalesce(F.from_json(F.when(_is_json(whole), whole), QUIZ)["questions"], F.from_json(F.lit("[]"), "array<struct<question:string,options:array<string>,answer:string>>"))


def outcome(text: Column) -> Column:
    """The model's document if it parses, else an error object."""
    return F.coalesce(embedded_json(text), F.lit('{"error": "no valid document"}'))


def valid_request(question: Column, top_k: Column) -> Column:
    """Question of 3 to 2000 characters, not blank; between 1 and 20 results."""
    size = F.length(question)
    return F.coalesce(size.between(3, 2000) & (F.trim(question) != "") & top_k.between(1, 20), F.lit(False))


def mentioned_layers(answer: Column, layers: list[str]) -> Column:
    """Layers named in the answer, all of them if none is."""
    found = F.filter(F.array(*[F.lit(x) for x in layers]), lambda x: F.contains(F.lower(answer), x))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(x) for x in layers]))
