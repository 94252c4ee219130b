"""Ordered signature rules for licences, in DataFrame expressions only.

A text passes the keyword filter if a root word occurs in it. It is read in pieces, and in each piece only
the stretches about root words are looked at. In a stretch a rule whose own keyword occurs is tried by one
pass of its regular expression, which gives matches and places together. Matches are detections; taken in
order of start, longest first, one that overlaps the one kept before it is suppressed, unless its priority
is higher, when it takes that one's place.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.license_rules import LETTERS, roots, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word of text whose A-Z are lower-cased (all but \x00-\x2F, \x3A-\x60, \x7B-\x7F); the same before lower-casing; base phrases.
# Written as what a word holds: the expression engine takes seven times as long over the same class negated.
WORD, ANY_WORD = f"[{LETTERS}]+", f"[A-Z{LETTERS}]+"
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
#: Characters either side of a root word that are looked at.
ABOUT = 400
#: Characters of a text that are read together, beside twice ABOUT either side: a match belongs to the piece that it starts in.
PIECE = 20_000
#: Stands around a match while it is cut out; texts have a blank in its place.
MARK = "\x01"
_RULE = "array<struct<label:string,keyword:string,regex:string,priority:int,weight:double>>"
_FOUND = "struct<a:int,nb:int,np:int,label:string,weight:double>"
_KEPT = "array<struct<a:int,b:int,priority:int,label:string,weight:double>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` is the value, found once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _text(value: str) -> str:
    """A SQL literal; backslashes are doubled."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(parts: str, wanted: str, item: str, kind: str) -> str:
    """SQL: ``item`` for those of the parts (p, i) that are wanted, with a.at as where the part starts."""
    return f"""aggregate(sequence(0, size({parts}) - 1), named_struct('at', 0, 'out', cast(array() as array<{kind}>)),
      (a, i) -> named_struct('at', a.at + length({parts}[i]), 'out', if({wanted}, array_append(a.out, {item}), a.out)), a -> a.out)"""


def _stretches(text: str, root: str) -> str:
    """SQL: array of (at, x): the text within ABOUT of root words, stretches that touch being one."""
    starts = _places("g", f"i > 0 or {text} rlike {_text('^(?:' + root + ')')}", "a.at", "int")
    last = "o[if(k + 1 < size(f), f[k + 1], size(o)) - 1]"
    cut = f"transform(f, (j, k) -> {_let('from_', f'greatest(o[j] - {ABOUT}, 0)', f'named_struct(\'at\', from_, \'x\', substring({text}, from_ + 1, {last} + {ABOUT} - from_))')})"
    firsts = f"filter(sequence(0, size(o) - 1), j -> j = 0 or o[j] - o[j - 1] > {2 * ABOUT})"
    none = "cast(array() as array<struct<at:int,x:string>>)"
    return _let("g", f"split({text}, {_text('(?=' + root + ')')})", _let("o", starts, f"if(size(o) = 0, {none}, {_let('f', firsts, cut)})"))


def _matches(base: str, table: str) -> str:
    """SQL: what the rules whose keyword occurs find in the stretch w, places counted from ``base``."""
    item = f"named_struct('a', {base} + w.at + a.at, 'nb', -({base} + w.at + a.at + length(p[i])), 'np', -r.priority, 'label', r.label, 'weight', r.weight)"
    parts = f"split(regexp_replace(w.x, r.regex, '{MARK}$0{MARK}'), '{MARK}')"  # gap, match, gap, match, ..., gap
    return f"flatten(transform(filter({table}, r -> contains(w.x, r.keyword)), r -> {_let('p', parts, _places('p', 'i % 2 = 1', item, _FOUND))}))"


def _sweep(found: str) -> str:
    """SQL: the detections that stay, in order of start."""
    return f"""aggregate(array_sort({found}), named_struct('last', cast(null as {_FOUND}), 'out', cast(array() as array<{_FOUND}>)),
      (s, d) -> case when s.last is null then named_struct('last', d, 'out', s.out)
        when d.a >= -s.last.nb then named_struct('last', d, 'out', array_append(s.out, s.last))
        when d.np < s.last.np then named_struct('last', d, 'out', s.out) else s end,
      s -> if(s.last is null, s.out, array_append(s.out, s.last)))"""


def _detections(text: str, table: str) -> Column:
    """Array of (a, b, priority, label, weight): character ranges that survive suppression, in order."""
    root = "|".join(re.escape(r).replace(r"\-", "-") for r in roots())
    side = 2 * ABOUT
    start = f"greatest(c * {PIECE} - {side}, 0)"
    within = _sweep(f"flatten(transform({_stretches('q.s', root)}, w -> {_matches('q.at', table)}))")
    own = f"filter({within}, d -> d.a >= c * {PIECE} and d.a < (c + 1) * {PIECE})"
    piece = _let("q", f"named_struct('at', {start}, 's', substring({text}, {start} + 1, (c + 1) * {PIECE} + {side} - {start}))", own)
    every = f"flatten(transform(sequence(0, cast(floor(greatest(length({text}) - 1, 0) / {PIECE}) as int)), c -> {piece}))"
    return F.expr(f"cast(transform({every}, d -> named_struct('a', d.a, 'b', -d.nb, 'priority', -d.np, 'label', d.label, 'weight', d.weight)) as {_KEPT})")


def _starts(words: str, phrase: tuple[str, ...]) -> Column:
    """Where the phrase's words stand consecutively, from 0."""
    n = len(phrase)
    test = " and ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(phrase))
    return F.expr(f"if(size({words}) < {n}, cast(array() as array<int>), filter(sequence(0, greatest(size({words}) - {n}, 0)), i -> {test}))")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Null and empty texts have no words, no labels (empty strings), score 0 and null word places.
    detections is an array of (a, b, priority, label, weight): character ranges that survive
    suppression. score is the chance that at least one of them is right if each is with its weight,
    and at least 0.5 where a base phrase stands. Of equal intervals the higher priority stays, then the
    label that sorts first. Rows are independent: repeated rows and null doc_ids are scanned like others,
    an empty table gives an empty table, other columns are not looked at. No shuffle. A text of n
    characters with m matches costs n + m, but for finding its pieces (a walk over it for each 20,000
    characters).
    """
    table = F.from_json(F.lit(json.dumps([dict(zip(("label", "keyword", "regex", "priority", "weight"), r)) for r in rules()])), _RULE)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a superset of the texts whose A-Z lower-cased form has a root word
    rows = rows.withColumn("some", F.lower("text")).withColumn("some", F.greatest(*(F.col("some").contains(r) for r in roots())))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when(F.col("some"), F.translate("text", UPPER + MARK, LOWER + " ")).alias("t"))
    gated = rows.withColumn("w", F.when(F.col("t").contains("license"), F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))).withColumn("rules", F.when(F.col("t").isNotNull(), table))
    empty = F.expr("cast(array() as array<int>)")
    none = F.expr(f"cast(array() as {_KEPT})")
    gated = gated.select("*", *(F.coalesce(_starts("w", phrase), empty).alias(f"at_{label}") for label, phrase in BASE), F.when(F.col("t").isNotNull(), _detections("t", "rules")).otherwise(none).alias("detections"))
    base = F.array_compact(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label, _ in BASE)))
    places = F.concat(*(F.col(f"at_{label}") for label, _ in BASE))
    done = gated.select("doc_id", "n_words", base.alias("base"), places.alias("places"), "detections")
    chance = 1 - F.aggregate("detections", F.lit(1.0), lambda s, d: s * (1 - d["weight"]))
    return done.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(chance, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"), "detections",
    )
