"""License scans by ordered signature rules, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased; rules are matched on the words joined by single blanks. Base
phrases are sequences of words; every place where one stands counts and its
label always stays. Each rule (:mod:`license_rules`) is tried on every text in
which its keyword occurs; keywords that hold a shorter one are looked for only
where that occurs. A detection is dropped if a detection of equal or stronger priority
contains its interval (equal intervals: the earlier rule stays); intervals
that merely overlap both stay. Everything is done inside the row: no shuffle,
no window over a text's detections, whole texts of any length.

Defined cases: a null text is an empty text, with no words, labels ``''``,
null first and last word and score 0; repeated rows are scanned alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .license_rules import CONFIDENCE, Rule, rules, shortest

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def joined_words(text: Column) -> Column:
    """The words of a text, each with a blank before it, and a last blank."""
    words = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, " "), F.lit(" "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """``(start, label)`` of every place of the phrases in an array of words."""
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split(" ")
        last = F.size(words) - len(parts)
        at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: reduce(
            and_, [F.get(words, i + k) == w for k, w in enumerate(parts)]))
        found.append(F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))))
    return F.concat(*found)


def intervals(text: Column, pattern: Column) -> Column:
    """``(start, end)`` in characters of all matches of ``pattern``, whole words only.

    Words may hold U+0085, U+2028 and U+2029, so the dot has to match them too."""
    probe = F.concat(F.lit(r"(?s)\G.*?((?<= )(?:"), pattern, F.lit(r")(?= ))"))
    used = F.transform(F.regexp_extract_all(text, probe, F.lit(0)), F.length)
    size = F.transform(F.regexp_extract_all(text, probe, F.lit(1)), F.length)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        F.arrays_zip(used.alias("used"), size.alias("size")), F.struct(F.lit(0).alias("at"), empty.alias("all")),
        lambda s, m: F.struct((s["at"] + m["used"]).alias("at"), F.concat(s["all"], F.array(F.struct(
            (s["at"] + m["used"] - m["size"]).alias("start"), (s["at"] + m["used"]).alias("end")))).alias("all")),
        lambda s: s["all"])


def detections(text: Column, rule_list: list[Rule]) -> Column:
    """Detections of all rules whose keyword occurs: ``start, below, priority,
    number, label`` with ``below`` = minus the end, for sorting."""
    by_word: dict[str, list[dict]] = {}
    for i, r in enumerate(rule_list):
        by_word.setdefault(r.keyword, []).append({"number": i, "label": r.label, "priority": r.priority, "pattern": r.pattern})
    heads = shortest(by_word)
    by_head: dict[str, list[dict]] = {h: [] for h in heads}
    for word in sorted(by_word):
        by_head[next(h for h in heads if h in word)].append({"word": word, "rules": by_word[word]})
    # one literal each, folded once, instead of thousands of expression nodes
    rule = "array<struct<number:int,label:string,priority:int,pattern:string>>"
    table = F.from_json(F.lit(json.dumps(by_head)), f"map<string,array<struct<word:string,rules:{rule}>>>")
    found = F.filter(F.from_json(F.lit(json.dumps(heads)), "array<string>"), lambda h: F.contains(text, h))
    words = F.filter(F.flatten(F.transform(found, lambda h: F.element_at(table, h))), lambda w: F.contains(text, w["word"]))
    active = F.flatten(F.transform(words, lambda w: w["rules"]))
    active = F.filter(active, lambda r: F.rlike(text, F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))))
    return F.flatten(F.transform(active, lambda r: F.transform(intervals(text, r["pattern"]), lambda m: F.struct(
        m["start"].alias("start"), (-m["end"]).alias("below"), r["priority"].alias("priority"), r["number"].alias("number"),
        r["label"].alias("label")))))


def suppress(hits: Column) -> Column:
    """Detections that no other contains; one sweep in the order of start,
    longest first, keeps the furthest end seen per priority."""
    levels = sorted(CONFIDENCE)
    kind = "struct<start:int,below:int,priority:int,number:int,label:string>"
    first = F.struct(*[F.lit(0).alias(f"e{p}") for p in levels], F.array().cast(f"array<{kind}>").alias("kept"))

    def step(s: Column, h: Column) -> Column:
        reach = reduce(lambda a, b: F.greatest(a, b), [F.when(h["priority"] >= p, s[f"e{p}"]).otherwise(0) for p in levels])
        ends = [F.when(h["priority"] == p, F.greatest(s[f"e{p}"], -h["below"])).otherwise(s[f"e{p}"]).alias(f"e{p}") for p in levels]
        return F.struct(*ends, F.when(reach >= -h["below"], s["kept"]).otherwise(F.concat(s["kept"], F.array(h))).alias("kept"))
    return F.aggregate(F.array_sort(hits), first, step, lambda s: s["kept"])


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, rule_list: list[Rule] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, detections`` (label, first and last character
    of the joined words, priority)."""
    rule_list = rules() if rule_list is None else rule_list
    ends = sorted({p.split(" ")[-1] for p in phrases})
    t = F.col("t")
    rows = docs.select("doc_id", joined_words(F.col("text").cast("string")).alias("t"))
    gate = reduce(or_, [F.contains(t, F.lit(w)) for w in ends])
    rows = rows.select("doc_id", "t", F.greatest(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - 1, F.lit(0))
                       .cast("long").alias("n_words"), gate.alias("gate"))
    rows = rows.withColumn("w", F.when(F.col("gate"), F.split(F.btrim(t, F.lit(" ")), " ")))
    places = F.array().cast("array<struct<start:int,label:string>>")
    rows = rows.withColumn("base", F.when(F.col("gate"), phrase_places(F.col("w"), phrases)).otherwise(places))
    rows = rows.withColumn("hits", suppress(detections(t, rule_list)))
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    known = F.array_sort(F.array_distinct(F.col("base.label")))
    every = F.array_sort(F.array_distinct(F.concat("base.label", "hits.label")))
    strongest = F.array_min("hits.priority")
    base_score = F.when(F.size("base") > 0, 0.5).otherwise(0.0)
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(known, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(base_score, F.coalesce(F.element_at(confidence, strongest), F.lit(0.0))).alias("score"),
        F.transform("hits", lambda h: F.struct(h["label"].alias("label"), h["start"].alias("start"),
                                               (-h["below"]).alias("end"), h["priority"].alias("priority"))).alias("detections"))
