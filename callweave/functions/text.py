"""Column expressions over call text, list cells and model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that generated text is cleaned of.
INVISIBLE = "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]"
LEADING_BULLET = "^[•●◦▪▫➤►➡✦—–-]\\s*"
EMOJI = (
    "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}"
    "\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}]+"
)
QUESTION_NUMBERING = "0123456789.-• "
FOOTER = "\n\n---\n"

#: Words that join two asks in one question.
SPLIT_PATTERN = r"(?i)\s*;\s*(?:(?:and|then|or)\s+)*|\s+(?:(?:and|then|or)\s+)+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def word_rows(df, keep: list[str], text: str = "text"):
    """One row per word of a text: ``(keep, length, term)`` with the text's word count.

    The outer form of the generator keeps Spark from adding a non-empty filter, which
    would tokenise every text again at the scan.
    """
    tokens = df.select(*keep, words(F.col(text)).alias("_words"))
    sized = tokens.select(*keep, F.size("_words").alias("length"), "_words")
    return sized.select(*keep, "length", F.explode_outer("_words").alias("term")).filter("term is not null")


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def python_float(value: Column) -> Column:
    """A double the way Python prints it; null prints as None."""
    shown = value.cast("string")
    small = F.regexp_replace(F.regexp_replace(shown, r"\.0E", "E"), r"E(-?)(\d)$", "e$10$2")
    return (
        F.when(value.isNull(), F.lit("None"))
        .when((F.abs(value) < 1e-3) & (F.abs(value) >= 1e-4), F.rtrim(value.cast("decimal(30,20)").cast("string"), F.lit("0")))
        .when(shown.contains("E"), F.regexp_replace(small, "E", "e"))
        .otherwise(shown)
    )


def call_string(domain: Column, intent: Column, reason: Column, turns: Column) -> Column:
    """A call as prompt text: a header, then one line per turn with its sentiment."""
    header = F.concat(
        F.lit("domain: "), F.coalesce(domain, F.lit("")),
        F.lit("\nintent: "), F.coalesce(intent, F.lit("")),
        F.lit("\nreason_for_call: "), F.coalesce(reason, F.lit("")), F.lit("\n\n"),
    )

    def line(turn: Column, index: Column) -> Column:
        said = F.array_join(
            F.transform(
                F.coalesce(turn["conversation"], F.array()),
                lambda u: F.concat(F.coalesce(u["speaker"], F.lit("None")), F.lit(": "),
                                   F.coalesce(u["utterance"], F.lit("None"))),
            ),
            " | ",
        )
        mood = turn["sentiment"]
        return F.concat(
            F.lit("turn "), index.cast("string"), F.lit(": "), said,
            F.lit(" [sentiment_score="), python_float(mood["score"]),
            F.lit(" label="), F.coalesce(mood["label"], F.lit("None")), F.lit("]"),
        )

    return F.concat(header, F.array_join(F.transform(F.coalesce(turns, F.array()), line), "\n"))


def preview(turns: Column) -> Column:
    """All utterances of a call in one line, untruncated."""
    said = F.flatten(F.transform(F.coalesce(turns, F.array()), lambda t: F.coalesce(t["conversation"], F.array())))
    return F.array_join(
        F.transform(
            said,
            lambda u: F.concat(F.coalesce(u["speaker"], F.lit("Unknown")), F.lit(": "),
                               F.coalesce(u["utterance"], F.lit(""))),
        ),
        " | ",
    )


def clean_question(text: Column) -> Column:
    return strip(F.ltrim(text, F.lit(QUESTION_NUMBERING)))


def nfkc():
    """Unicode compatibility normalisation, the one step without a built-in."""

    @F.pandas_udf(T.StringType())
    def normalise(texts):
        import unicodedata

        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return normalise


def clean_response(text: Column, remove_emojis: bool = True) -> Column:
    """Generated text without invisible characters, code ticks, a leading bullet and emojis."""
    out = nfkc()(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, INVISIBLE, "")
    out = F.regexp_replace(out, "`{1,3}", "")
    out = F.regexp_replace(out, LEADING_BULLET, "")
    if remove_emojis:
        out = F.regexp_replace(out, EMOJI, "")
    return strip(out)


def parse_list_cell(cell: Column) -> Column:
    """A CSV cell as a list: null is empty, ``[...]`` is parsed, anything else is one item."""
    text = strip(cell)
    bracketed = text.startswith("[") & text.endswith("]")
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return (
        F.when(cell.isNull(), F.array().cast("array<string>"))
        .when(bracketed & parsed.isNotNull(), parsed)
        .otherwise(F.array(text))
    )


def clean_tid_list(cell: Column) -> Column:
    """Transcript ids of a cell; numbers written as ``5.0`` become ``5`` and ids stay strings."""
    return F.transform(
        parse_list_cell(cell),
        lambda x: F.when(x.rlike(r"^\d+(\.\d+)?$"), F.regexp_replace(x, r"^0+(?=\d)|\.\d+$", "")).otherwise(x),
    )


def join_list_cell(items: Column) -> Column:
    return F.array_join(F.coalesce(items, F.array()), " ")


def parse_score(text: Column) -> Column:
    """First number among the tokens, clamped to [0, 1]; 0 without any."""
    tokens = F.filter(
        F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(" ")), r"\s+"),
        lambda t: t.rlike(r"^[+-]?(\d+(_?\d)*\.?(\d+)?|\.\d+)([eE][+-]?\d+)?$"),
    )
    first = F.get(tokens, F.lit(0)).try_cast("double")
    return F.when(first.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), first)))


def extract_json_array(text: Column) -> Column:
    """The outermost ``[...]`` of a chatty answer; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


def json_field(text: Column, name: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(text, f"$.{name}"), F.lit(default))


def chat_title(message: Column) -> Column:
    return F.concat(F.substring(message, 1, 40), F.when(F.length(message) > 40, F.lit("...")).otherwise(F.lit("")))


def strip_footer(text: Column) -> Column:
    """Text before the last footer separator."""
    return F.when(
        text.contains(FOOTER), F.regexp_replace(text, r"(?s)^(.*)\n\n---\n.*$", "$1")
    ).otherwise(text)


def message_metadata(metadata: Column, model: Column, token_count: Column) -> Column:
    """Stored metadata, else the model and its token count when a model is set."""
    built = F.when(
        model.isNotNull() & (model != ""),
        F.concat(F.lit('{"model":'), F.to_json(F.array(model)).substr(F.lit(2), F.length(F.to_json(F.array(model))) - 2),
                 F.lit(',"token_count":'), F.coalesce(token_count.cast("string"), F.lit("null")), F.lit("}")),
    )
    return F.coalesce(metadata, built)


def sub_questions(text: Column) -> Column:
    """The parts of a question joined by and / then / or / ;, in their own wording."""
    parts = F.filter(F.transform(F.split(text, SPLIT_PATTERN), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def is_snake_case(keyword: Column) -> Column:
    return keyword.rlike("^[a-z]+(_[a-z]+)*$")


def word_count(text: Column) -> Column:
    return F.size(whitespace_tokens(text))


def cluster_id(field: Column, level: str, number: Column) -> Column:
    return F.concat_ws("_", field, F.lit(level), number.cast("string"))


def cluster_name(name: Column, field: Column, level: str, number: Column) -> Column:
    """The given name, or the numbered fallback (fixed value) when labelling produced none."""
    return F.coalesce(name, F.concat(field, F.lit(f" {level} Group "), number.cast("string")))
