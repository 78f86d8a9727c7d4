"""Offset-preserving deobfuscation and detection of personal data (operator 3)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghound.llm.common import empty_if_null, prepare, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  They match what the plain forms match, but start only where
# a leftmost match can start, so long runs of one class take linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        # an earlier run is never part of a later match: it ends at this sign
        done = max(done, at + 1)
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    # leading zeros do not change a part's value
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _phone_ok(s: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in s) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DOTTED.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if _phone_ok(m[0])]
    return found


# Letters of other scripts that look like ASCII ones.  Wide, mathematical, circled and other
# compatibility forms and the digits of all scripts follow by rule, see `plain_form`.
LOOKALIKES = dict(zip(
    "аеорсухіѕјԁһԛԝАВЕКМНОРСТХІЅЈУοιναρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡıⅼ‐‑‒–․",
    "aeopcyxisjdhqwABEKMHOPCTXISJYoivapuABEZHIKMNOPTYXagil----.", strict=True))
#: Characters without a width, which are taken out.
UNSEEN = "­​‌‍⁠﻿"
# The digits 0 to 9 as words of English, German, French and Spanish.
DIGIT_WORDS = {w: str(i) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
) for i, w in enumerate(words.split())} | {"oh": "0"}
# Numbers that stand as one part of a dotted address.
NUMBER_WORDS = DIGIT_WORDS | {w: str(i) for i, w in enumerate(
    "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 10)}
PLUS_WORDS = ("plus", "más")
AT_WORDS = ("at", "ät", "arroba", "arobase")
DOT_WORDS = ("dot", "punkt", "point", "punto")
#: Words that stand before "at" in front of a web address and are no mailbox.
NOT_NAMES = frozenset("""a an and are at available be contact find found from go here hosted is it join learn look me
    more now online out read see shop site start store sign them there these this those up us visit was website
    were you""".split())
#: Fewest digit words in a row that are read as a number.
MIN_SPELLED = 3


@cache
def plain_form(c: str) -> str | None:
    """The ASCII form of a disguised character (may be empty); None for any other."""
    if c.isascii():
        return None
    if c in UNSEEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else None


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_BLANK = r"[\x20\t]"
_LETTER = r"[^\W\d_]"
_WORD = _any(DIGIT_WORDS)
_GAP = r"[\x20\t,-]+"
_SPELLED = re.compile(rf"(?i)(?<!{_LETTER})(?:{_any(PLUS_WORDS)}[\x20\t-]+)?{_WORD}"
                      rf"(?:{_GAP}{_WORD}){{{MIN_SPELLED - 1},}}(?!{_LETTER})")
_SPELLED_STEP = re.compile(rf"(?i)({_any(PLUS_WORDS)}|{_WORD})(?!{_LETTER})([\x20\t,-]*)")
_PART = rf"(?:[0-9]{{1,3}}|{_any(NUMBER_WORDS)})"
_DOTTED_WORDS = re.compile(rf"(?i)(?<![^\W_]){_PART}(?:\.{_PART}){{3}}(?![^\W_])")
_NUMBER_WORD = re.compile(rf"(?i){_any(NUMBER_WORDS)}(?!{_LETTER})")
_OPEN, _CLOSE = rf"{_BLANK}*[(\[{{<]{_BLANK}*", rf"{_BLANK}*[)\]}}>]{_BLANK}*"
_BRACKET_AT = re.compile(rf"(?i){_OPEN}(?:{_any(AT_WORDS)}|@){_CLOSE}")
_BRACKET_DOT_ = rf"{_OPEN}(?:{_any(DOT_WORDS)}|\.){_CLOSE}"
_BRACKET_DOT = re.compile(f"(?i){_BRACKET_DOT_}")
_PLAIN_AT = re.compile(rf"(?i)(?<=[a-z0-9]){_BLANK}+{_any(AT_WORDS)}{_BLANK}+(?=[a-z0-9-]+"
                       rf"(?:{_BLANK}+{_any(DOT_WORDS)}{_BLANK}+[a-z0-9]|{_BRACKET_DOT_}[a-z0-9]|(\.)[a-z0-9-]*[a-z]))")
_PLAIN_DOT = re.compile(rf"(?i)(?<=[a-z0-9]){_BLANK}+dot{_BLANK}+(?=[a-z0-9])")
_LABEL_DOT = re.compile(rf"(?i)[a-z0-9-]+({_BLANK}+{_any(DOT_WORDS)}{_BLANK}+)(?=[a-z0-9])")
_LAST_WORD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# cheap tests on the lower-cased text; only texts that pass one are rewritten
# two digit words after a gap, as they stand in every run of MIN_SPELLED
_MAY_SPELL = re.compile(rf"[\x20\t,-]{_WORD}{_GAP}{_WORD}(?!{_LETTER})")
_MAY_AT = re.compile(rf"[(\[{{<]{_BLANK}*(?:{_any(AT_WORDS)}|{_any(DOT_WORDS)}|@|\.){_BLANK}*[)\]}}>]")
_MAY_PLAIN = re.compile(rf"{_BLANK}(?:dot{_BLANK}|{_any(AT_WORDS)}{_BLANK}+[a-z0-9-]+"
                        rf"(?:{_BLANK}+{_any(DOT_WORDS)}{_BLANK}|{_BLANK}*[(\[{{<]|\.[a-z0-9]))")
# the middle parts of a dotted address
_MAY_DOTTED = re.compile(r"\.[^\W_]{1,9}\.[^\W_]{1,9}\.")


class Mapped:
    """A text made by edits, which finds the source span of any of its spans.

    Only the edits are kept, a layer for each transducer: what lies between two
    of them is shifted by a known number.
    """

    def __init__(self, text: str, layers: tuple = ()):
        self.text = text
        self.layers = layers

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace disjoint spans, given in order; each new character stands for its whole span."""
        if not edits:
            return self
        text, layer, at, size = [], ([], [], [], []), 0, 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            size += a - at
            for values, v in zip(layer, (size, size + len(new), a, b)):
                values.append(v)
            size += len(new)
            at = b
        text.append(self.text[at:])
        return Mapped("".join(text), (*self.layers, layer))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of the characters from ``start`` to before ``end``; not empty."""
        last = end - 1
        for new_start, new_end, old_start, old_end in reversed(self.layers):
            def old(p):
                i = bisect_right(new_start, p) - 1
                if i < 0:
                    return p, p
                if p < new_end[i]:
                    return old_start[i], old_end[i] - 1
                return p - new_end[i] + old_end[i], p - new_end[i] + old_end[i]
            start, last = old(start)[0], old(last)[1]
        return start, last + 1


def lookalike_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    odd = "".join(c for c in set(text) if plain_form(c) is not None)
    return [(m.start(), m.end(), plain_form(m[0])) for m in re.finditer("[" + re.escape(odd) + "]", text)] if odd else []


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED.finditer(text):
        for m in _SPELLED_STEP.finditer(text, run.start(), run.end()):
            word = m[1].lower()
            # the blank after a digit word belongs to it, that after the last one is not in the run: the digits close up
            edits.append((m.start(), m.end(), "+" if word in PLUS_WORDS else DIGIT_WORDS[word]))
    for run in _DOTTED_WORDS.finditer(text):
        edits += [(m.start(), m.end(), NUMBER_WORDS[m[0].lower()])
                  for m in _NUMBER_WORD.finditer(text, run.start(), run.end())]
    return _disjoint(edits)


def _disjoint(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    edits, done = [], 0
    for a, b, new in sorted(found):
        if a >= done:
            edits.append((a, b, new))
            done = b
    return edits


def _is_name(text: str, end: int) -> bool:
    """Whether the word before ``end`` may be a mailbox in front of "at" and a web address."""
    word = _LAST_WORD.search(text, max(0, end - 64), end)
    return word is not None and word[0].lower() not in NOT_NAMES


def at_dot_edits(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), ".") for rx in (_BRACKET_DOT, _PLAIN_DOT) for m in rx.finditer(text)]
    at_signs = [*_BRACKET_AT.finditer(text), *(m for m in _PLAIN_AT.finditer(text)
                                               if m[1] is None or _is_name(text, m.start()))]
    for m in at_signs:
        found.append((m.start(), m.end(), "@"))
        label = _LABEL_DOT.match(text, m.end())
        while label:  # dots in words of the domain
            found.append((*label.span(1), "."))
            label = _LABEL_DOT.match(text, label.end())
    return _disjoint(found)


TRANSDUCERS = (lookalike_edits, spelled_edits, at_dot_edits)


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that show only after the transducers; they may contain or overlap base spans, but equal none of their kind."""
    low = text.lower()
    if not (_MAY_PLAIN.search(low) or _MAY_AT.search(low) or _MAY_SPELL.search(low) or _MAY_DOTTED.search(low)
            or not text.isascii() and any(plain_form(c) is not None for c in set(text))):
        return []
    view = Mapped(text)
    for step in TRANSDUCERS:
        view = view.rewrite(step(view.text))
    if not view.layers:
        return []
    mapped = [(kind, *view.source(a, b)) for kind, a, b in base_spans(view.text)]
    taken = set(base)
    return [span for span in dict.fromkeys(mapped) if span not in taken]


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    more = disguised_spans(text, base)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[at:a], f"<{kind}>"]
        at = last = max(last, b)
    return "".join(out) + text[at:] if out else text


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every text: rows (doc_id, base, spans), arrays of (kind, start, end).

    Base spans are the leftmost non-overlapping matches of each kind that pass
    its check.  Then transducers rewrite lookalike and unseen characters, digits
    in words and at/dot disguises (English, German, French, Spanish), keeping
    the edits, which lead every character back to its source span; what the
    base patterns find in the rewritten text is mapped back and added.  One
    narrow stage, no shuffle; a document is one row, whole.

    Cases: a null text is empty and has no spans; repeated rows give repeated
    rows; an empty table gives none; other columns are not read.
    """
    span = "array<struct<kind:string,start:long,end:long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [all_spans(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"],
                                "base": [[dict(zip(("kind", "start", "end"), s)) for s in b] for b, _ in both],
                                "spans": [[dict(zip(("kind", "start", "end"), s)) for s in m] for _, m in both]})

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_if_null(F.col("text")).alias("text"))
            .mapInPandas(run, f"doc_id long, base {span}, spans {span}"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of :func:`find_pii` in ``text`` replaced by its kind.

    All columns and rows stay; a null text stays null; ``n_chars``, where
    present, is the new length.
    """
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact_text(t, all_spans(t)[1]))

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    text = lambda c: F.coalesce(F.array_join(F.transform(
        c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
    n = lambda k, c="base": F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
