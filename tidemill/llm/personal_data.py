"""Personal data in plain and in disguise: transducers undo disguises and keep track of where each character came from."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import slices, table

KINDS = ("email", "ip", "card", "phone")

# Characters that look like ASCII ones, those that show nothing, words for digits and signs, and common last labels of addresses.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ο": "o", "。": ".", "｡": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ",
}
UNSEEN = "­​‌‍‎‏⁠﻿"
DIGITS = ("zero oh zéro null cero", "one un eins uno", "two deux zwei dos", "three trois drei tres", "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve")
PLUS, DOT, AT, TIMES = "plus más", "dot point punkt punto", "at arobase arroba klammeraffe", {"double": 2, "triple": 3}
LAST_LABELS = "com org net edu gov mil int info biz io co ai app dev eu uk us de fr es it nl ch at be ca au nz in jp cn ru br mx ar cl pt pl se no dk fi ie example test invalid"

_VALUE = {w: str(k) for k, own in enumerate(DIGITS) for w in own.split()} | {w: "+" for w in PLUS.split()} | {w: "." for w in DOT.split()}

_CARD = regex.compile(r"[0-9](?:[\x20-]?[0-9])++")
_IP = regex.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = regex.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[-1::-2])) % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """Kind (place in KINDS), begin and end of each identifier, by kind and then begin: leftmost, not overlapping within a kind.

    Each pattern runs in time proportional to the text: an address is looked for from its @, digits from where they begin.
    """
    found = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            begin = m.start()
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < m.start():
                found.append((0, begin, m.end()))
                done = m.end()
    if "." in text:
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


#: Stretches of a text and what stands for each.
Edits = list[tuple[int, int, str]]


def _looks_like(c: str) -> str | None:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and "!" <= plain <= "~" and c not in "ªº¹²³" else None


@lru_cache(maxsize=1)
def _seen_as() -> tuple[dict[str, str], re.Pattern]:
    """What each character beyond ASCII looks like, of those that look like an ASCII one or show nothing, and a pattern for them."""
    places = [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]
    known = {c: p for c in map(chr, places) if (p := _looks_like(c)) is not None} | dict.fromkeys(UNSEEN, "")
    codes = sorted(map(ord, known))
    runs = [[codes[0], codes[0]]]
    for c in codes[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return known, re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in runs) + "]")


def lookalikes(text: str) -> Edits:
    """Letters, digits and signs that look like ASCII ones; characters that show nothing go."""
    if text.isascii():
        return []
    known, pattern = _seen_as()
    return [(m.start(), m.end(), known[m[0]]) for m in pattern.finditer(text)]


def _any(words: str) -> str:
    return "|".join(words.split())


_WRAPPED = regex.compile(rf"(?i)[ \t]{{0,3}}[(\[{{<][ \t]?(?:(?P<at>{_any(AT)}|@)|{_any(DOT)}|\.)[ \t]?[)\]}}>][ \t]{{0,3}}")
_CODED = regex.compile(r"(?i)(?P<at>&commat;|%40)|(?P<dot>&period;|%2e)|&#(?:0{0,4}(?P<ten>[0-9]{2,3})|x0{0,4}(?P<hex>[0-9a-f]{2}));")
_JOINED = regex.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+]++(?P<at>[_-](?:{_any(AT)})[_-])[A-Za-z0-9]++(?:(?P<dot>[_-](?:{_any(DOT)})[_-])[A-Za-z0-9]++){{0,4}}(?P<dot>[_-](?:{_any(DOT)})[_-])(?:{_any(LAST_LABELS)})(?![A-Za-z0-9-])")


def wrapped_signs(text: str) -> Edits:
    """(at), [dot], name_at_host_dot_com, &#64; and other references to ASCII characters."""
    out: Edits = []
    if any(opening in text for opening in "([{<"):
        out += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _WRAPPED.finditer(text)]
    if "&" in text or "%" in text:
        for m in _CODED.finditer(text):
            code = 64 if m["at"] else 46 if m["dot"] else int(m["ten"]) if m["ten"] else int(m["hex"], 16)
            if 33 <= code <= 126:
                out.append((m.start(), m.end(), chr(code)))
    if "_" in text or "-" in text:
        for m in _JOINED.finditer(text):
            out += [(*m.span("at"), "@"), *[(a, b, ".") for a, b in m.spans("dot")]]
    return sorted(out)


_SPOKEN_DOT = rf"[ \t]{{1,3}}(?:{_any(DOT)})[ \t]{{1,3}}"
_SPOKEN = regex.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?P<dot>{_SPOKEN_DOT})[A-Za-z0-9._%+-]++){{0,4}}?"
    rf"(?:(?P<word>[ \t]{{1,3}}(?:{_any(AT)})[ \t]{{1,3}})|(?P<sign>[ \t]{{0,3}}@[ \t]{{0,3}}))[A-Za-z0-9-]++(?:(?:(?P<dot>{_SPOKEN_DOT}|[ \t]\.[ \t])|\.)[A-Za-z0-9-]++){{0,4}}(?:(?P<dot>{_SPOKEN_DOT}|[ \t]\.[ \t])|\.)(?:{_any(LAST_LABELS)})(?![A-Za-z0-9-])"
)
_SPOKEN_IP = regex.compile(rf"(?i)(?<![\w.])[0-9]{{1,3}}(?:(?P<dot>{_SPOKEN_DOT}|[ \t]\.[ \t])[0-9]{{1,3}}){{3}}(?!\w)")
_HINT = regex.compile(rf"(?i)(?<!\w)(?:{_any(DOT)})(?!\w)|[ \t]@|@[ \t]|[ \t]\.[ \t]|[ \t](?-i:AT)[ \t]")


def spoken_addresses(text: str) -> Edits:
    """name at host dot com, name @ host . com, name AT host.com and 10 dot 0 dot 0 dot 1: `at` counts only where a `dot` is spoken too or AT alone is in capitals, and the last label must be a common one."""
    if not _HINT.search(text):
        return []
    out = []
    for m in _SPOKEN.finditer(text):
        spoken = any(d.strip() != "." for d in m.captures("dot"))
        shouted = m["word"] and m["word"].strip() == "AT" and any(c.islower() for c in text[m.start() : m.start("word")])
        if not (spoken or shouted) if m["word"] else m["sign"] == "@" and not m.captures("dot"):
            continue
        out += [(*m.span("word" if m["word"] else "sign"), "@"), *[(a, b, ".") for a, b in m.spans("dot")]]
    out += [(a, b, ".") for m in _SPOKEN_IP.finditer(text) for a, b in m.spans("dot")]
    return sorted(out)


_SAID = "|".join(sorted((w for w, v in _VALUE.items() if v.isdigit()), key=len, reverse=True))
_GAP = r"[ \t,()\-]{1,3}"
_ITEM = rf"(?:(?:(?:{_any(' '.join(TIMES))}){_GAP})?(?:{_SAID})|[0-9]++)(?!\w)"
_SAID_RUN = regex.compile(rf"(?i)(?<![\w+])(?:(?:{_any(PLUS)}){_GAP}|\+[ \t]?)?{_ITEM}(?:(?:{_GAP}(?:(?:{_any(DOT)}){_GAP})?|\.){_ITEM}){{2,}}+")
_SAID_PART = regex.compile(rf"(?i)(?:(?P<times>{_any(' '.join(TIMES))}){_GAP})?(?P<word>{_SAID}|{_any(PLUS)}|{_any(DOT)})(?!\w)|(?P<other>[0-9.+]++)|(?P<gap>{_GAP})")
_SAID_TWICE = regex.compile(rf"(?i)(?<!\w)(?:{_SAID})(?!\w)(?:{_GAP}|{_GAP}(?:{_any(DOT)}){_GAP})(?:{_SAID}|{_any(' '.join(TIMES))}|[0-9])")


def said_digits(text: str) -> Edits:
    """four one one two, plus four nine, double five, ten digits and more in words, with figures between them: at least two words stand in a row."""
    if not _SAID_TWICE.search(text):
        return []
    out = []
    for m in _SAID_RUN.finditer(text):
        if _SAID_TWICE.search(m[0]):
            for p in _SAID_PART.finditer(text, *m.span()):
                if not p["other"]:
                    out.append((*p.span(), _VALUE[p["word"].lower()] * TIMES.get((p["times"] or "").lower(), 1) if p["word"] else ""))
    return out


_MIXED = regex.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl](?:[\x20.()-]{0,2}[0-9OoIl]){7,}+(?![A-Za-z0-9])")


def letters_as_digits(text: str) -> Edits:
    """O and o for 0, I and l for 1, in a run of eight figures and more of which most are real ones."""
    out = []
    for m in _MIXED.finditer(text):
        letters = [k for k in range(*m.span()) if text[k] in "OoIl"]
        if letters and sum(c.isdigit() for c in m[0]) > 2 * len(letters):
            out += [(k, k + 1, "0" if text[k] in "Oo" else "1") for k in letters]
    return out


TRANSDUCERS: tuple[Callable[[str], Edits], ...] = (lookalikes, wrapped_signs, spoken_addresses, said_digits, letters_as_digits)


class Layer:
    """What one transducer changed: stretches of its output and the stretches of its input that they stand for."""

    def __init__(self, text: str, edits: Edits) -> None:
        pieces, self.new, self.new_end, self.old_end, self.old = [], [], [], [], []
        at = size = 0
        for begin, end, put in edits:
            if begin < at:
                continue
            pieces += [text[at:begin], put]
            size += begin - at
            self.new.append(size)
            size += len(put)
            self.new_end.append(size)
            self.old.append(begin)
            self.old_end.append(end)
            at = end
        self.text = "".join([*pieces, text[at:]])

    def source(self, begin: int, end: int) -> tuple[int, int]:
        """Where a stretch of the output came from, whole edits included."""
        return self._place(begin)[0], self._place(end - 1)[1]

    def _place(self, c: int) -> tuple[int, int]:
        k = bisect_right(self.new, c) - 1
        if k < 0:
            return c, c + 1
        if c < self.new_end[k]:
            return self.old[k], self.old_end[k]
        c += self.old_end[k] - self.new_end[k]
        return c, c + 1


def disguised(text: str, transducers: tuple[Callable[[str], Edits], ...] = TRANSDUCERS) -> list[tuple[int, int, int]]:
    """Identifiers of the text with disguises undone, at their places in text, by kind and begin. Nothing where no disguise is found."""
    layers: list[Layer] = []
    for transducer in transducers:
        now = layers[-1].text if layers else text
        if edits := transducer(now):
            layers.append(Layer(now, edits))
    if not layers:
        return []
    out = set()
    for kind, begin, end in identifiers(layers[-1].text):
        for layer in reversed(layers):
            begin, end = layer.source(begin, end)
        out.add((kind, begin, end))
    return sorted(out)


def spans_in(text: str) -> list[tuple[int, int, int, bool]]:
    """Kind, begin, end and whether it is plain, by kind, begin and end. Disguised identifiers that lie within a plain one of their kind are left out."""
    plain = identifiers(text)
    out = [(*s, True) for s in plain]
    if more := disguised(text):
        begins = [s[:2] for s in plain]
        for kind, begin, end in more:
            k = bisect_right(begins, (kind, begin)) - 1
            if k < 0 or plain[k][0] != kind or plain[k][2] < end:
                out.append((kind, begin, end, False))
    return sorted(out)


SPANS = "found array<struct<kind:string,start:int,end:int,plain:boolean>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns of keep, and found: the spans of e-mail and IP addresses, card and telephone numbers in every whole text.

    Spans count code points, end exclusive, and stand by kind (KINDS), start and end. Plain ones are matched as they are written, leftmost and
    not overlapping within a kind. Others are matched after look-alike characters, wrapped, coded or spoken signs,
    spoken digits and letters for digits are undone, one after another; a span is then traced back through each step to the characters it came from.
    Null and empty texts have none. Each row is searched by itself: nulls, ties and repeated rows in other columns change nothing. A column named found in keep raises ValueError.
    """
    names = [id_col, *[c for c in dict.fromkeys(keep) if c != id_col]]
    if "found" in names:
        raise ValueError("a kept column may not be named found")
    read = docs.select(*[F.col(c) for c in names], F.col(text_col).alias("text__"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], SPANS])
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text__"):
            found = []
            for low, high in zip(part.offsets, part.offsets[1:], strict=False):
                spans = spans_in(part.data[low:high].tobytes().decode())
                found.append([{"kind": KINDS[k], "start": a, "end": b, "plain": p} for k, a, b, p in spans])
            yield pa.RecordBatch.from_arrays([*part.rows.columns[:-1], pa.array(found, pa.list_(kind_of))], names=[*names, "found"])

    return read.mapInArrow(run, schema)


def mask_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in text_col replaced by its kind in brackets, such as [email]; overlapping spans become one, named after the first."""
    names = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    found = find_personal_data(docs.toDF(*names.values()), names[id_col], names[text_col], tuple(names.values()))
    text = F.col(names[text_col])

    def step(done: Column, span: Column) -> Column:
        begin = F.greatest(span["start"], done["at"])
        put = F.when(span["start"] >= done["at"], F.concat(F.substring(text, done["at"] + 1, begin - done["at"]), F.lit("["), span["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(done["out"], put).alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    ordered = F.array_sort("found", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    masked = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return found.withColumn("masked__", F.when(F.size("found") > 0, masked).otherwise(text)).select(*[F.col("masked__" if c == text_col else n).alias(c) for c, n in names.items()])


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    plain = F.filter("found", lambda s: s["plain"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.array_remove(F.transform(plain, lambda s: s["kind"] == F.lit(kind)), F.lit(False))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), (F.size("found") - F.size(plain)).cast("long").alias("n_disguised"))
