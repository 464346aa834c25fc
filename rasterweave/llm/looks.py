"""One consistent form for texts that look the same."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import product

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rasterweave.functions.tiles import one_row_per_id
from rasterweave.operators.skew import ROWS_PER_TASK, salted_join
from rasterweave.session import cut_lineage

# Letters drawn alike, each with the characters that take its shape in common upright fonts. The first of
# a line is the consistent form. Shapes that are only similar (Greek alpha and a, 0 and O, 1 and l and I) are not here.
LOOK_ALIKES = """
A Α А Ꭺ
B Β В Ᏼ
C Ϲ С Ⅽ Ꮯ
D Ⅾ Ꭰ
E Ε Е Ꭼ
G Ԍ Ꮐ
H Η Н Ꮋ
I Ι І Ӏ Ⅰ
J Ј Ϳ Ꭻ
K Κ К Ꮶ
L Ⅼ Ꮮ
M Μ М Ϻ Ⅿ Ꮇ
N Ν
O Ο О Օ
P Ρ Р Ꮲ
Q Ԛ
R Ꮢ
S Ѕ Տ Ꮪ
T Τ Т Ꭲ
U Ս
V Ⅴ Ѵ Ꮩ
W Ԝ Ꮃ
X Χ Х Ⅹ
Y Υ Ү
Z Ζ Ꮓ
a а ɑ
c с ϲ ⅽ
d ԁ ⅾ
e е
g ɡ ց
h һ հ
i і ⅰ
j ј ϳ
l ⅼ ӏ
m ⅿ
n ո
o ο о օ
p р ρ
q ԛ զ
s ѕ
u ս
v ν ѵ ⅴ
w ԝ
x х ⅹ
y у
ə ә
ɵ ө
æ ӕ
Æ Ӕ
Γ Г
Π П
Φ Ф
Ð Đ Ɖ
Σ Ʃ
к ĸ
"""

#: Default-ignorable characters that fonts draw as a blank rather than as nothing; they count as a space.
DRAWN_BLANK = "ᅟᅠㅤﾠ⠀"

_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\u0000-\u0008\u000e-\u001b\u007f-\u0084\u0086-\u009f--[ᅟᅠㅤﾠ؀-؅۝܏࣢]]", regex.V1)
_VISIBLE_TEXT = regex.compile(r"[\p{L}\p{N}]")


class Rules(dict):
    """Keys of one or more characters to their form. Every rule comes in through put, which refuses a contradiction."""

    def put(self, key: str, form: str) -> None:
        if self.setdefault(key, form) != form:
            raise ValueError(f"{key!a} is mapped to {self[key]!a} and to {form!a}")


#: Code points with rules; beyond lie unified ideographs, tags and private use.
LAST_CODE = 0x20000


def mapping() -> Rules:
    """Single characters to their form: widths and spaces by rule, look-alikes and drawn blanks by the tables.

    Raises ValueError if two rules disagree or if a result is itself mapped to something else.
    """
    out = Rules()
    for code in range(0x80, LAST_CODE):
        ch = chr(code)
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if ch in DRAWN_BLANK or unicodedata.category(ch) == "Zs":
            out.put(ch, " ")
        elif kind in ("<wide>", "<narrow>"):
            out.put(ch, "".join(chr(int(x, 16)) for x in rest.split()))
        elif ch == "µ":  # the micro sign, a compatibility form of mu without a shape of its own
            out.put(ch, "μ")
    for line in LOOK_ALIKES.strip().splitlines():
        first, *rest = line.split()
        for ch in rest:
            out.put(ch, first)
    out = Rules({a: "".join(out.get(c, c) for c in b) for a, b in out.items()})
    for a, b in out.items():
        for c in b:
            if out.get(c, c) != c:
                raise ValueError(f"U+{ord(a):04X} leads to U+{ord(c):04X}, which is mapped again")
    return out


def compiled() -> Rules:
    """mapping() and the clusters: every canonical composite, whole, apart, and with its parts in any of their shapes.

    So a letter with its marks is one key, whichever alphabet or width the letter and the marks were taken from, and a
    Hangul syllable is one key however it is divided. All go through the conflict check.
    """
    single = mapping()
    shapes: dict[str, list[str]] = {}
    for a, b in single.items():
        shapes.setdefault(b, []).append(a)
    out = Rules(single)
    for code in range(0x80, LAST_CODE):
        ch = chr(code)
        if not unicodedata.decomposition(ch) or unicodedata.decomposition(ch).startswith("<"):
            continue
        parts = [single.get(c, c) for c in unicodedata.normalize("NFD", ch)]
        form = unicodedata.normalize("NFC", "".join(parts))
        out.put(ch, form)
        if len(parts) > 1:
            for key in product(*[[p, *shapes.get(p, ())] for p in parts]):
                out.put("".join(key), form)
    for code in range(0xAC00, 0xD7A4):  # Hangul syllables: lead, vowel and perhaps a tail
        ch = chr(code)
        apart = unicodedata.normalize("NFD", ch)
        out.put(apart, ch)
        if len(apart) == 3:
            out.put(unicodedata.normalize("NFC", apart[:2]) + apart[2], ch)
    return out


class Transducer(dict):
    """Clusters to their form. It begins with the compiled keys; clusters that are no key are matched once and remembered.

    Such a cluster is put in canonical order without its invisible characters and is then replaced by the longest keys
    from left to right; what remains of it are marks without a rule, which are put in order. The memory is bounded.
    """

    #: A cluster is a Hangul block, or a character with all marks and invisible characters that follow it.
    BOUND, LONGEST = 131_072, 24

    def __init__(self) -> None:
        super().__init__()
        self.keys = compiled()
        self.update(self.keys)
        self.widest = max(map(len, self.keys))
        tail = rf"(?:\p{{M}}|[\uff9e\uff9f]|{_INVISIBLE.pattern})"
        hide = f"(?:{_INVISIBLE.pattern})*+"
        jamo = rf"[ᄀ-ᅞ가-힣](?:{hide}[ᄀ-ᅞᅡ-ᇿ])*+{tail}*+"
        # Visible ASCII without a tail is its own form and is stepped over.
        self.clusters = regex.compile(rf"{jamo}|{_INVISIBLE.pattern}{tail}*+|[\x00-\x7f]{tail}++|[^\x00-\x7f]{tail}*+", regex.V1)

    def longest_keys(self, text: str) -> str:
        """text with the longest key at each place replaced by its form."""
        out, at = [], 0
        while at < len(text):
            for end in range(min(len(text), at + self.widest), at, -1):
                if text[at:end] in self.keys:
                    out.append(self.keys[text[at:end]])
                    break
            else:
                end = at + 1
                out.append(text[at])
            at = end
        return "".join(out)

    def form(self, cluster: str) -> str:
        bare = _INVISIBLE.sub("", cluster)
        if bare in self.keys:
            return self.keys[bare]
        # A width can bring a mark (narrow voiced kana), so the order is set before and after.
        apart = unicodedata.normalize("NFD", self.longest_keys(unicodedata.normalize("NFD", bare)))
        return unicodedata.normalize("NFC", self.longest_keys(apart))

    def __missing__(self, cluster: str) -> str:
        out = self.form(cluster)
        if len(cluster) <= self.LONGEST:
            if len(self) >= self.BOUND:
                self.clear()
                self.update(self.keys)
            self[cluster] = out
        return out

    def canonical(self, text: str) -> str:
        if text.isascii():
            return text if text.isprintable() else _INVISIBLE.sub("", text)
        return self.clusters.sub(lambda m: self[m.group()], text)


def canonical_text(text: str) -> str:
    """The consistent form of one text (see canonical)."""
    return _machine().canonical(text)


_MACHINE: list[Transducer] = []


def _machine() -> Transducer:
    if not _MACHINE:
        _MACHINE.append(Transducer())
    return _MACHINE[0]


@F.pandas_udf(StringType())
def _canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    machine = _machine()
    for texts in batches:
        yield pd.Series([None if t is None else machine.canonical(t) for t in texts], dtype=object)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _look_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, digest of the text, digest of its look; texts without a letter or digit are left out."""
    machine = _machine()
    for batch in batches:
        kept, raw, look = [], [], []
        for k, text in enumerate(batch.column("_text").to_pylist()):
            form = machine.canonical(text)
            if _VISIBLE_TEXT.search(form):
                kept.append(k)
                raw.append(_digest(text))
                look.append(raw[-1] if form == text else _digest(form))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), pa.array(raw, pa.binary()), pa.array(look, pa.binary())], names=["_id", "_raw", "_look"])


def canonical(text: Column) -> Column:
    """One consistent form of text: texts that look the same become equal, others stay distinct.

    Widths, composed or combined accents, every kind of space (one for one), characters without a visible form and
    letters drawn alike are unified in one pass over grapheme clusters. Wording, order, case, visible accents and
    punctuation, raised figures and the number of visible spaces are kept; so are tabs and line breaks. The form of a
    form is itself. Null stays null, the empty text empty.
    """
    return _canonical(text)


def look_digests(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_id, _raw, _look of every text with a letter or digit, once per id: 128-bit digests, written to the checkpoint folder.

    Each text is read and brought to its form once, in one Arrow pass; nothing that follows touches texts.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).filter(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(_look_batches, f"_id {kind}, _raw binary, _look binary"))


def _varied(looks: DataFrame) -> DataFrame:
    """Rows whose look has more than one text. Looks with a single one (all plain copies) go by an aggregation that combines first."""
    varied = looks.groupBy("_look").agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi")).filter("_lo <> _hi").select("_look")
    return one_row_per_id(looks.join(varied, "_look", "left_semi"), "_id", "_look", "_raw")


def same_look(docs: DataFrame, id_col: str, text: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pairs of ids with <id>_a < <id>_b whose texts look the same but are not the same string.

    Texts without a letter or digit, null and empty texts and null ids are in no pair; rows that repeat an id count
    once (the least if they disagree). A look with very many documents is dealt over several tasks. The rows are as many
    as the pairs; look_classes says the same in one row per document.
    """
    found = _varied(look_digests(docs, id_col, text))
    a = found.select("_look", F.col("_id").alias("_a"), F.col("_raw").alias("_ma"))
    b = found.select("_look", F.col("_id").alias("_b"), F.col("_raw").alias("_mb"))
    pairs = salted_join(a, b, ["_look"], F.col("_a"), (F.col("_a") < F.col("_b")) & (F.col("_ma") != F.col("_mb")), rows_per_task)
    return pairs.select(F.col("_a").alias(f"{id_col}_a"), F.col("_b").alias(f"{id_col}_b"))


def look_classes(docs: DataFrame, id_col: str, text: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """id, look_class (the least id of its look), n_members and n_links (members with another text) of each document with a link.

    The class form of same_look: one row per document, however many pairs a look has. A document without a link has no row.
    """
    found = _varied(look_digests(docs, id_col, text))
    texts = found.groupBy("_look", "_raw").agg(F.count(F.lit(1)).alias("_same"), F.min("_id").alias("_least"))
    looks = texts.groupBy("_look").agg(F.sum("_same").alias("n_members"), F.min("_least").alias("look_class"), F.count(F.lit(1)).alias("_texts")).filter("_texts > 1")
    known = texts.select("_look", "_raw", "_same").join(looks, "_look").select("_look", "_raw", "look_class", "n_members", (F.col("n_members") - F.col("_same")).alias("n_links"))
    out = salted_join(found, known, ["_look", "_raw"], F.col("_id"), None, rows_per_task)
    return out.select(F.col("_id").alias(id_col), "look_class", "n_members", "n_links")
