"""License scan with ordered signature rules (DataFrame functions only).

A text is normalised to its words in lower case with one space before each. Texts that hold none of the rules'
gate words are done; in the others the rules whose keyword stands in the text are run, each as one regex whose
places come from what lies between its matches. Detections are then resolved in one sweep by start: one that lies
inside the interval of a detection of lower priority number, or of a longer one of its own priority, goes. A
reservation of all rights, which most license texts hold too, yields to every other detection of the text.
Everything of a text happens in its row, so there is no shuffle.

Defined cases: a null text counts as empty; an empty text has no words, no detections and score 0; a very long text is
scanned whole, in its row; of detections with the same place and priority (ties) the rule that stands first stays;
repeated rows are scanned each; an empty table gives no rows; further columns are ignored. A word is a run of digits, letters
a-z (A-Z are lowered) and non-ASCII characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, lower_ascii
from tessera.llm.license_rules import rules

#: What separates words, in a Java regex.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: What yields to every other detection.
RESERVATION = "all rights reserved"
#: Confidence of a kept detection by priority.
CONFIDENCE = (1.0, 0.98, 0.95, 0.8, 0.5)


def normalised(text: Column) -> Column:
    """The words of a text, joined by one space."""
    return F.trim(F.regexp_replace(lower_ascii(text), SEPARATOR, " "))


def n_words(joined: Column) -> Column:
    """The number of words in a normalised text."""
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "))) + 1).cast("long")


def gate_words(table) -> list[str]:
    """Words such that each rule's keyword holds one of them: few, and rare in ordinary text."""
    stems = ["licen", "copyright", "rights reserved", "public domain", "creative commons", "creativecommons"]
    left = [k for _, _, _, k, _ in table if not any(s in k for s in stems)]
    return stems + list(dict.fromkeys(left))


def _in(text: str, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.col(text), F.lit(w))
    return found


def _array(table) -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return "array(" + ", ".join(f"struct({n} AS rule, {quoted(label)} AS label, {p} AS priority, {quoted(f' {k} ')} AS keyword, {quoted(f' (?:{r})(?= )')} AS regex)" for n, label, p, k, r in table) + ")"


#: Detections that a fold appends one by one before they are joined to the rest.
CHUNK = 512
_DETECTIONS = "CAST(array() AS ARRAY<STRUCT<start INT, stop INT, priority INT, rule INT, label STRING>>)"


def _folded(rows: str, start: str, step: str) -> str:
    """SQL: `rows` folded from `start` by `step`, a lambda from (s, d) to the next (at, found), to all that was found.

    An array grows by being copied, so one that grew with every row would cost the square of a long text's detections. Rows
    are folded in chunks, and only a chunk's findings are joined to the rest.
    """
    part = f"aggregate(slice(every, CAST(k * {CHUNK} + 1 AS INT), {CHUNK}), struct(s.at AS at, {_DETECTIONS} AS found), {step})"
    return f"""element_at(transform(array({rows}), every -> aggregate(sequence(0L, greatest(size(every) - 1, 0) div {CHUNK}),
  struct({start} AS at, {_DETECTIONS} AS found),
  (s, k) -> element_at(transform(array({part}), p -> struct(p.at AS at, concat(s.found, p.found) AS found)), 1),
  s -> s.found)), 1)"""


#: All matches of a rule in __words with their places: a fold over what lies between the matches.
_PLACES = "transform(filter({rules}, r -> contains(__words, r.keyword)), r -> " + _folded(
    "element_at(transform(array(regexp_extract_all(__words, r.regex, 0)), hits -> zip_with(slice(split(__words, r.regex, -1), 1, size(hits)), hits, (g, h) -> struct(g AS gap, h AS hit))), 1)",
    "0",
    """(t, m) -> struct(t.at + length(m.gap) + length(m.hit) AS at,
    concat(t.found, array(struct(t.at + length(m.gap) AS start, t.at + length(m.gap) + length(m.hit) AS stop, r.priority AS priority, r.rule AS rule, r.label AS label))) AS found)""",
) + ")"

#: One sweep: `at` has for each priority the furthest end of what stays or stood before.
_SWEEP = _folded(
    """array_sort(__found, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start WHEN a.priority <> b.priority THEN a.priority - b.priority
    WHEN a.stop <> b.stop THEN b.stop - a.stop ELSE a.rule - b.rule END)""",
    "array({zeros})",
    """(t, d) -> struct(
    transform(t.at, (e, i) -> IF(i = d.priority, greatest(e, d.stop), e)) AS at,
    IF(exists(slice(t.at, 1, d.priority + 1), e -> e >= d.stop), t.found, concat(t.found, array(d))) AS found)""",
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table=None) -> DataFrame:
    """doc_id, n_words, base (array of place and label), kept (array of start, stop, priority, rule, label)."""
    table = table or rules()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(doc_text(text_col)).alias("__joined"))
    rows = rows.select("doc_id", n_words(F.col("__joined")).alias("n_words"), F.concat(F.lit(" "), "__joined", F.lit(" ")).alias("__words"))
    rows = rows.withColumn("__gate", _in("__words", gate_words(table)))
    found = F.when(F.col("__gate"), F.expr(f"flatten({_PLACES.format(rules=_array(table))})"))
    places = " WHEN ".join("(" + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + f") THEN '{label}'" for phrase, label in BASE)
    base = f"filter(transform(w, (x, i) -> struct(CAST(i AS BIGINT) AS place, CASE WHEN {places} END AS label)), b -> b.label IS NOT NULL)".replace("w[", "get(w, ").replace("] =", ") =")
    # the words of a text that holds a base phrase's last word
    held = F.when(F.contains(F.col("__words"), F.lit(" license ")), F.expr("split(trim(__words), ' ')")).alias("w")
    rows = rows.select("doc_id", "n_words", held, found.alias("__found"))
    rows = rows.select("doc_id", "n_words", F.when(F.col("w").isNotNull(), F.expr(base)).alias("base"), F.when(F.size("__found") > 0, F.expr(_SWEEP.format(zeros=", ".join(["0"] * len(CONFIDENCE))))).alias("kept"))
    weak = F.array(*(F.lit(n) for n, _, _, keyword, _ in table if keyword == RESERVATION)).cast("array<int>")
    own = F.filter("kept", lambda d: ~F.array_contains(weak, d["rule"]))
    return rows.withColumn("kept", F.when(F.size(own) > 0, own).otherwise(F.col("kept")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, priority, rule, start, stop of every detection that stays; places in the normalised text."""
    return scan(docs, id_col, text_col).select("doc_id", F.explode("kept").alias("d")).select("doc_id", "d.label", "d.priority", "d.rule", "d.start", "d.stop")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`; score is the confidence of the surest detection."""
    from tessera.sources.tables import table

    rows = scan(table(spark, sf_dir, "documents"))
    base = F.coalesce(F.col("base.label"), F.array().cast("array<string>"))
    own = F.coalesce(F.col("kept.label"), F.array().cast("array<string>"))
    sure = F.expr(f"aggregate(kept, 0D, (s, d) -> greatest(s, element_at(array({', '.join(f'{c}D' for c in CONFIDENCE)}), d.priority + 1)))")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("base.place").alias("first_word"),
        F.array_max("base.place").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(F.coalesce(sure, F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0)).alias("score"),
        F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_detections"),
    )
