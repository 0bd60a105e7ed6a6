"""Secret scan: fixed patterns, and values in a credential's context that would take many guesses.

A password-like value costs what the cheapest way to guess it costs. Dynamic programming over its characters finds the
segmentation of least cost, in bits, into words, dates, repeats, keyboard walks, sequences and brute-force spans; every
segment also costs the choice of its kind. A word costs the logarithm of its share among all words of the corpus, more with
capitals and digits in place of letters. Words are counted over all documents, without the values themselves, and joined to
the parts of the values, so no vocabulary is held in one place. Values of MIN_BITS or more are reported.

Repeated values are judged once. The word counts of a batch are added up before they are shuffled, and the join that takes
verdicts back to rows is salted, so a value or word that a third of the documents hold makes no large task.

Defined results: a null or empty text has no spans; texts and values of any length are taken whole; repeated rows are scanned
row by row; overlapping spans of different kinds all stay; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import text_of, written
from tidebar.llm.tokens import slices

# ---- spans. The base patterns are fixed values.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile(ACCESS), re.compile("[0-9a-f]{16,}")

#: Names of credentials, what stands between name and value, and the value. After `is` or a scheme the value needs a digit.
_NAME = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization|[_-]?key)?"
_VALUE = r"""([^\s"'`<>,;(){}\[\]]{4,})"""
_CONTEXTS = [re.compile(p, re.ASCII | re.IGNORECASE) for p in (
    rf"""(?:{_NAME})["'`]?[ \t]*(?:=>|:=|[:=])[ \t]*["'`]?(?:(?:bearer|basic)[ ]+)?{_VALUE}""",
    rf"""(?:{_NAME})["'`]?[ \t]+is[ \t]*:?[ \t]*["'`]?(?=\S*\d){_VALUE}""",
    rf"\b(?:bearer|basic)[ ]+(?=\S*\d){_VALUE}",
    r"://[^\s/:@]+:([^\s/@]{4,})@")]
#: What texts must contain for any of these to match; found by Arrow before Python looks at a text.
_MAYBE = r"(?i)pass|pwd|secret|token|key|credential|auth|bearer|basic|AKIA|://[^\s/:@]+:|[0-9a-f]{16}"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and kind."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def context_values(text: str) -> list[tuple[int, int]]:
    """Spans of values in a credential's context; references to variables are none."""
    found = set()
    for pattern in _CONTEXTS:
        for m in pattern.finditer(text):
            value = m[1].rstrip(".:!?")
            if len(value) >= 4 and value[0] not in "$%":
                found.add((m.start(1), m.start(1) + len(value)))
    return sorted(found)


# ---- guess cost
MIN_BITS = 36.0
#: One of six kinds of segment.
SEGMENT = math.log2(6)
WORD_LENGTHS = range(3, 25)
UNITS = range(1, 17)
#: Digits and signs that stand for letters (fixed values).
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "2": "z"}
#: Rows of the keyboard, plain and shifted, each half a key right of the one above (fixed values).
KEYBOARD = (("1234567890-=", "!@#$%^&*()_+"), ("qwertyuiop[]\\", "QWERTYUIOP{}|"), ("asdfghjkl;'", 'ASDFGHJKL:"'), ("zxcvbnm,./", "ZXCVBNM<>?"))
_KEYS = {c: (row, at) for row, layers in enumerate(KEYBOARD) for layer in layers for at, c in enumerate(layer)}
_STEPS = {(0, 1), (0, -1), (-1, 0), (-1, 1), (1, 0), (1, -1)}
#: Bits of a walk's first key, of a step in a new direction and of one straight on; of a sequence's first sign and each step.
WALK, TURN, STRAIGHT, SEQUENCE, NEXT = math.log2(94), math.log2(6), 0.5, math.log2(62) + 1, 0.25
_YEAR, _MONTH, _DAY, _CUT = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "[-/._]"
_DATES = [(re.compile(p), bits) for order in ((_YEAR, _MONTH, _DAY), (_DAY, _MONTH, _YEAR), (_MONTH, _DAY, _YEAR))
          for p, bits in (("".join(order), math.log2(366 * 200)), (_CUT.join(order), math.log2(366 * 200) + 2))]
_DATES += [(re.compile(_YEAR), math.log2(200)), (re.compile(_DAY + _MONTH + "[0-9]{2}"), math.log2(366 * 100))]


def char_bits(c: str) -> float:
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 12.0


def plain(value: str) -> tuple[str, list[int]]:
    """Lower case with letters for the signs that stand for them, and how many such signs come before each place."""
    lower = [k if len(k := c.lower()) == 1 else c for c in value]
    before = [0]
    for c in lower:
        before.append(before[-1] + (c in LEET))
    return "".join(LEET.get(c, c) for c in lower), before


def parts_of(value: str) -> Iterator[tuple[int, int]]:
    """Spans that may be words: letters, at most a third of them by signs."""
    letters, leet = plain(value)
    run = 0
    for end in range(1, len(value) + 1):
        run = run + 1 if letters[end - 1].isalpha() else 0
        for length in WORD_LENGTHS:
            if length > run:
                break
            if 3 * (leet[end] - leet[end - length]) <= length:
                yield end - length, end


def case_bits(word: str) -> float:
    upper, lower = sum(c.isupper() for c in word), sum(c.islower() for c in word)
    if not upper:
        return 0.0
    if not lower or upper == 1 and word[0].isupper():
        return 1.0
    return math.log2(sum(math.comb(upper + lower, k) for k in range(1, min(upper, lower) + 1)))


def walk_step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbour."""
    if a not in _KEYS or b not in _KEYS:
        return None
    step = (_KEYS[b][0] - _KEYS[a][0], _KEYS[b][1] - _KEYS[a][1])
    return step if step in _STEPS else None


def sequence_step(a: str, b: str) -> int:
    """1 or -1 between neighbours among digits or letters of one case, else 0."""
    alike = a.isdigit() and b.isdigit() or a.isalpha() and b.isalpha() and a.isupper() == b.isupper()
    return ord(b) - ord(a) if alike and a.isascii() and b.isascii() and abs(ord(b) - ord(a)) == 1 else 0


def guess_bits(value: str, words: dict[str, float], units: dict[str, float] | None = None) -> float:
    """Bits of the cheapest segmentation; `words` has the bits of words. A repeat takes as many copies as follow. `units` keeps
    the bits of what is repeated."""
    units = {} if units is None else units
    if value in units:
        return units[value]
    n = len(value)
    letters, leet = plain(value)
    best = [0.0] + [math.inf] * n
    spans: dict[int, list[int]] = {}
    for i, j in parts_of(value):
        if letters[i:j] in words:
            spans.setdefault(i, []).append(j)
    copies = {}
    for u in UNITS:  # how many further signs agree with the sign u places on
        if 2 * u > n:
            break
        agree = [0] * (n + 1)
        for i in range(n - u - 1, -1, -1):
            agree[i] = agree[i + 1] + 1 if value[i] == value[i + u] else 0
        copies[u] = agree
    brute = walk = sequence = math.inf
    came = went = None
    for i in range(n):
        at = best[i] + SEGMENT
        for j in spans.get(i, ()):
            word = value[i:j]
            best[j] = min(best[j], at + words[letters[i:j]] + leet[j] - leet[i] + case_bits(word))
        if value[i].isdigit():
            for pattern, bits in _DATES:
                if m := pattern.match(value, i):
                    best[m.end()] = min(best[m.end()], at + bits)
        for u, agree in copies.items():
            if agree[i] >= u:
                k = 1 + agree[i] // u
                best[i + u * k] = min(best[i + u * k], at + guess_bits(value[i:i + u], words, units) + math.log2(k))
        brute = min(brute, at) + char_bits(value[i])
        best[i + 1] = min(best[i + 1], brute)
        if i:
            key, sign = walk_step(value[i - 1], value[i]), sequence_step(value[i - 1], value[i])
            start = best[i - 1] + SEGMENT
            walk = min(walk + (STRAIGHT if key == came else TURN), start + WALK + TURN) if key else math.inf
            sequence = min(sequence + NEXT if sign == went else math.inf, start + SEQUENCE + NEXT) if sign else math.inf
            came, went = key, sign
            best[i + 1] = min(best[i + 1], walk, sequence)
    if n <= UNITS[-1]:
        units[value] = best[n]
    return best[n]


# ---- over tables
_FOUND = ("doc_id long, base array<struct<start:long,end:long,kind:string>>, "
          "`values` array<struct<start:long,end:long,value:string>>")


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and context values of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), (c, pa.string())])) for c in ("kind", "value")]
        for batch in batches:
            base, values = [], []
            maybe = pc.match_substring_regex(batch["text"], _MAYBE)
            for look, text in zip(maybe.to_pylist(), batch["text"]):
                text = text.as_py() if look else ""
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in base_spans(text)])
                values.append([{"start": s, "end": e, "value": text[s:e]} for s, e in context_values(text)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, kinds[0]), pa.array(values, kinds[1])], ["doc_id", "base", "values"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(task, _FOUND)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of letters in lower case over all texts, without the values in a credential's context."""

    def without(text: str) -> str:
        out, at = [], 0
        for s, e in context_values(text):
            out.append(text[at:max(s, at)])
            at = max(at, e)
        return " ".join([*out, text[at:]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                maybe = pc.match_substring_regex(part["text"], _MAYBE)
                masked = [without(t) for t in part["text"].filter(maybe).to_pylist()]
                texts = pc.replace_with_mask(part["text"], maybe, pa.array(masked, pa.string()))
                words = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " "), " ").flatten()
                counted = pc.value_counts(words)
                length = pc.utf8_length(counted.field("values"))
                fit = pc.and_(pc.greater_equal(length, WORD_LENGTHS[0]), pc.less_equal(length, WORD_LENGTHS[-1]))
                counted = counted.filter(fit)
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])

    return (docs.select(text_of().alias("text")).mapInArrow(task, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def costs(values: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, bits) of distinct values (key, value), given word counts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch["key"].to_pylist(), batch["value"].to_pylist()):
                letters = plain(value)[0]
                words = sorted({letters[i:j] for i, j in parts_of(value)})
                for at in range(0, len(words), 10_000):
                    part = words[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array(part, pa.string())], ["key", "word"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [guess_bits(v, {w["word"]: w["bits"] for w in words or ()})
                    for v, words in zip(batch["value"].to_pylist(), batch["words"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(bits, pa.float64())], ["key", "bits"])

    counts = written(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 1  # one number
    known = counts.select("word", F.log2(F.lit(float(total)) / F.col("n")).alias("bits"))
    words = (values.mapInArrow(parts, "key string, word string").join(known, "word")
             .groupBy("key").agg(F.collect_list(F.struct("word", "bits")).alias("words")))  # as many as parts of one value
    return values.join(words, "key", "left").select("key", "value", "words").mapInArrow(least, "key string, bits double")


SALTS = 16


def secrets(docs: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, end, kind) in code points, by start and the order of KINDS. `spans` holds the base
    spans and, of kind guess, the values in a credential's context that cost `min_bits` or more."""
    rows = written(_scanned(docs).withColumn("_row", F.monotonically_increasing_id()), "scanned")
    plain_rows = rows.filter(F.size("values") == 0).select("doc_id", "base", F.col("base").alias("spans"))
    some = rows.filter(F.size("values") > 0)
    each = some.select("_row", F.explode("values").alias("v")).select("_row", "v.start", "v.end", F.sha2("v.value", 256).alias("key"), "v.value")
    distinct = written(each.groupBy("key").agg(F.min("value").alias("value")), "values")
    costly = costs(distinct, word_counts(docs)).filter(F.col("bits") >= min_bits)
    costly = written(costly, "costs").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    added = (each.drop("value").withColumn("_salt", F.pmod(F.xxhash64("_row", "start"), F.lit(SALTS)).cast("int")).join(costly, ["key", "_salt"])
             .groupBy("_row").agg(F.collect_list(F.struct("start", "end", F.lit("guess").alias("kind"))).alias("added")))  # one text's
    spans = F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:long,end:long,kind:string>>")))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["end"], s["kind"])))
    ordered = F.transform(order, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return plain_rows.unionByName(some.join(added, "_row", "left").select("doc_id", "base", ordered.alias("spans")))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets(docs).select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
