"""Texts that look the same, in one consistent form.

A transducer is compiled from rules: each grapheme cluster (a character with its combining marks, voice marks and conjoining letters, and the
invisible characters between them) is replaced by the form that all its look-alikes share.  Longest match, one pass.  The images of single characters,
over all of Unicode, and of all clusters that have a composed character are made beforehand and checked for conflicts: the image of an image is itself,
and a composed character and its parts have one image.  Other clusters follow the same rule where they occur.

The *key* of a text is for comparison: letters of other scripts that are drawn like a Latin letter become that letter.  The *readable* text is made
from the key alone, so that equal keys give equal texts: words of another script get their own letters back.
"""

from __future__ import annotations

import hashlib
import string
import sys
import unicodedata as U
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# What the Unicode confusables call similar, but a reader tells apart in running text.
LOOSE = frozenset("αγιρσυгѡ")
#: signs drawn alike
SIGNS = {"‐": "-", "‑": "-", "∕": "/", "∶": ":", "µ": "μ"}
#: compatibility forms drawn like their parts: ligatures and Roman numerals (ranges of code points)
PARTS = ((0xFB00, 0xFB06), (0x2160, 0x217F), (0x0132, 0x0133), (0x01C7, 0x01CC), (0x2024, 0x2026))
#: kinds of compatibility mapping that change width or font only
SAME = ("<wide>", "<narrow>", "<font>", "<small>")
#: half-width voice marks and conjoining vowels and finals belong to the letter before them
JOINED = "\uff9e\uff9f\u1161-\u11ff"


def confusables(spark) -> tuple[tuple[str, str], ...]:
    """(letter, Latin letter drawn alike) by the Unicode confusables (UTS 39), read from the ICU library that Spark brings along.

    Letters of other scripts whose skeleton is that of one Latin letter of the same case (letters without case: a capital). Phonetic letters of the Latin
    script are distinct on purpose, and LOOSE ones can be told apart. A few hundred entries.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = lambda chars: checker.getSkeleton(0, "\n".join(chars)).split("\n")
    latin = {(k, U.category(c)): c for c, k in zip(string.ascii_letters, skeletons(string.ascii_letters))}
    others = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if U.category(c) in ("Lu", "Ll", "Lo") and not U.decomposition(c) and not U.name(c, "").startswith("LATIN")]
    pairs = ((c, latin.get((k, "Lu" if U.category(c) == "Lo" else U.category(c)))) for c, k in zip(others, skeletons(others)))
    return tuple((c, to) for c, to in pairs if to and c not in LOOSE)


def invisible(ch: str) -> bool:
    """Format characters, variation selectors and the grapheme joiner draw nothing."""
    o = ord(ch)
    return U.category(ch) == "Cf" and not (0x0600 <= o <= 0x08FF) and o not in (0x110BD, 0x110CD) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5)


def build_table(letters: dict[str, str]) -> dict[str, str]:
    """{character: image} of all characters that change, from the rules; raises on a conflict."""
    alike = {**letters, **SIGNS}
    table: dict[str, str] = {}
    for o in range(0x80, sys.maxunicode + 1):
        ch = chr(o)
        d, kind = U.decomposition(ch), U.category(ch)
        if not (d or kind in ("Cf", "Zs", "Mn", "Lo") or ch in alike) or kind == "Cs":
            continue
        if invisible(ch):
            table[ch] = ""
            continue
        if kind == "Zs":
            table[ch] = " "
            continue
        image = ch
        if d.startswith(SAME) or (d.startswith("<compat>") and any(a <= o <= b for a, b in PARTS)):
            image = U.normalize("NFKC", ch)
            if "\uffa1" <= ch <= "\uffdc":  # half-width Hangul letters stand alone, NFKC would make parts of syllables of them
                image = chr(int(d.split()[1], 16))
        image = U.normalize("NFC", "".join(alike.get(c, c) for c in U.normalize("NFD", image)))
        if image != ch:
            table[ch] = image
    for ch, image in table.items():
        again = "".join(table.get(c, c) for c in image)
        if again != image:
            raise ValueError(f"conflict: {ch!r} becomes {image!r}, which becomes {again!r}")
    return table


def _ranges(chars) -> str:
    """Characters as ranges of a class."""
    out: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class _Images(dict):
    """{cluster: image}; what isn't there yet follows from the rule."""

    def __init__(self, rule, most: int = 500_000):
        super().__init__()
        self.rule, self.most = rule, most

    def __missing__(self, cluster):
        image = self.rule(cluster)
        if len(self) < self.most:
            self[cluster] = image
        return image


class Transducer:
    """Text to its key. Line breaks, blanks in number, letter case, digits, accents and superscripts stay as they are."""

    def __init__(self, letters=()):
        self.table = build_table(dict(letters))
        self.single = {ord(a): b for a, b in self.table.items()}
        self.images = _Images(self._rule)
        for ch in map(chr, range(0xC0, sys.maxunicode + 1)):
            d = U.decomposition(ch)
            if " " in d and d[0] != "<":  # a composed character: it and its parts are one cluster
                parts, image = U.normalize("NFD", ch), self.images[ch]
                if self.images[parts] != image or self.images[image] != image:
                    raise ValueError(f"conflict: {ch!r}, {parts!r} and {image!r}")
        hidden = _ranges(c for c, to in self.table.items() if to == "")
        self.joining = frozenset(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if U.category(c)[0] == "M" or "\u1161" <= c <= "\u11ff" or c in "\uff9e\uff9f" or self.table.get(c) == "")
        mark = rf"\p{{M}}{JOINED}"
        self.scan = regex.compile(rf"[^{mark}{hidden}][{hidden}]*[{mark}][{mark}{hidden}]*|[{mark}{hidden}]+")

    def _rule(self, cluster: str) -> str:
        return U.normalize("NFC", U.normalize("NFD", cluster.translate(self.single)).translate(self.single))

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        used = set(text)
        if used.isdisjoint(self.joining):  # every character is a cluster
            return text if used.isdisjoint(self.table) else text.translate(self.single)
        out, at = [], 0
        for m in self.scan.finditer(text):
            out.append(text[at : m.start()].translate(self.single))
            out.append(self.images[m.group()])
            at = m.end()
        out.append(text[at:].translate(self.single))
        return "".join(out)


@lru_cache(maxsize=4)
def transducer(letters: tuple = ()) -> Transducer:
    return Transducer(letters)


_WORD = regex.compile(r"[\p{L}\p{M}]+")
#: scripts that get their letters back, with their usual letters, which go before rare ones of the same look
SCRIPTS = {"Cyrillic": (0x0410, 0x0460), "Greek": (0x0391, 0x03CA), "Armenian": (0x0531, 0x0588)}


class Readable:
    """A key as text: words that hold a letter only one script has are written in it; words of shared letters follow the word before them, the first ones Latin."""

    def __init__(self, letters=()):
        self.own, self.back, self.only = {}, {}, {}
        for script, (lo, hi) in SCRIPTS.items():
            self.own[script] = regex.compile(rf"\p{{{script}}}")
            usual = sorted(((c, to) for c, to in letters if self.own[script].match(c)), key=lambda x: not lo <= ord(x[0]) < hi)
            self.back[script] = {}
            for c, to in usual:
                self.back[script].setdefault(ord(to), c)
            shared = "".join(map(chr, self.back[script]))
            self.only[script] = regex.compile(rf"[\p{{Latin}}--[{shared}]]" if shared else r"\p{Latin}", regex.V1)
        self.any = regex.compile("|".join(rf"\p{{{s}}}" for s in SCRIPTS))

    def __call__(self, key: str) -> str:
        if key.isascii() or not self.any.search(key):
            return key
        script = None

        def word(m):
            nonlocal script
            w = U.normalize("NFD", m.group())
            own = next((s for s in SCRIPTS if self.own[s].search(w)), None)
            if own is None and (script is None or self.only[script].search(w)):
                script = None
                return m.group()
            script = own or script
            return U.normalize("NFC", w.translate(self.back[script]))

        return _WORD.sub(word, key)


@lru_cache(maxsize=4)
def readable(letters: tuple = ()) -> Readable:
    return Readable(letters)


def consistent(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, text, key): every text in its consistent form, and its key. Texts that look alike have equal keys and equal texts.

    Null stays null, empty empty; repeated rows stay; very long texts are taken whole. Other columns are left out.
    """
    letters = confusables(docs.sparkSession)

    def run(batches):
        t, back = transducer(letters), readable(letters)
        for pdf in batches:
            keys = [t(x) if isinstance(x, str) else None for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [None if k is None else back(k) for k in keys], "key": keys})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, text string, key string")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, look, exact): 128-bit digests of the consistent form and of the text as it is. Texts without a visible character are left out."""

    letters = confusables(docs.sparkSession)

    def run(batches):
        t = transducer(letters)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if isinstance(text, str) and not pd.isna(doc):
                    form = t(text)
                    if form and not form.isspace():
                        rows.append((int(doc), digest(form), digest(text)))
            yield pd.DataFrame(rows, columns=["doc_id", "look", "exact"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, look binary, exact binary")


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts differ as strings and look the same.

    Exact copies form classes; only pairs of different classes of one look are made, and then their members, so no pair is made that isn't a
    result. Rows with null doc_id or text have no pairs; repeated rows of a document count once.
    """
    members = _alike(docs)
    classes = members.select("look", "exact").distinct()
    pairs = classes.withColumnRenamed("exact", "ea").join(classes.withColumnRenamed("exact", "eb"), "look").where("ea < eb").select("ea", "eb")
    left = members.select(F.col("exact").alias("ea"), F.col("doc_id").alias("a"))
    right = members.select(F.col("exact").alias("eb"), F.col("doc_id").alias("b"))
    both = pairs.join(left, "ea").join(right, "eb").where("a <> b")
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def _alike(docs: DataFrame) -> DataFrame:
    """(doc_id, look, exact) of the documents that look like a document of another text."""
    prints = cut(fingerprints(docs))  # 40 bytes a document, read twice
    looks = prints.groupBy("look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("look")
    return prints.join(looks, "look", "left_semi").distinct()


def lookalike_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, text_id), one row for each document that looks like one of another text: class_id is the least doc_id of its look, text_id the least
    doc_id of its exact text. The same classes as the pairs, in a size that grows with the documents only."""
    members = _alike(docs)
    least = members.groupBy("look", "exact").agg(F.min("doc_id").alias("text_id"))
    heads = least.groupBy("look").agg(F.min("text_id").alias("class_id"))
    return members.join(least, ["look", "exact"]).join(heads, "look").select("doc_id", "class_id", "text_id")
