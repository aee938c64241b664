"""Reading unit labels: segmentation into prefix, root, factor and exponent by dynamic programming over tries, with all readings of an ambiguous label.

Each decomposition has a cost; a label's readings are weighed by it and by how likely their dimension is for the field at hand (:func:`readings`).
"""

from __future__ import annotations

import math
from functools import lru_cache

# SI prefixes (name, symbol, power of ten); roots of units: names and symbols, dimension, canonical name.
PREFIXES = (
    ("quetta", "Q", 30), ("ronna", "R", 27), ("yotta", "Y", 24), ("zetta", "Z", 21), ("exa", "E", 18), ("peta", "P", 15), ("tera", "T", 12), ("giga", "G", 9), ("mega", "M", 6), ("kilo", "k", 3), ("hecto", "h", 2), ("deca", "da", 1),
    ("deci", "d", -1), ("centi", "c", -2), ("milli", "m", -3), ("micro", "µ", -6), ("micro", "u", -6), ("nano", "n", -9), ("pico", "p", -12), ("femto", "f", -15), ("atto", "a", -18), ("zepto", "z", -21), ("yocto", "y", -24), ("ronto", "r", -27), ("quecto", "q", -30),
)
ROOTS = (
    (("celsius", "centigrade", "C"), "temperature", "C"), (("fahrenheit", "F"), "temperature", "F"), (("kelvin", "kelvins", "K"), "temperature", "K"), (("rankine", "Ra"), "temperature", "Ra"),
    (("coulomb", "C"), "charge", "coulomb"), (("farad", "F"), "capacitance", "farad"), (("meter", "metre", "meters", "metres", "m"), "length", "m"), (("inch", "inches", "in"), "length", "in"), (("foot", "feet", "ft"), "length", "ft"),
    (("second", "seconds", "sec", "s"), "time", "s"), (("minute", "minutes", "min"), "time", "min"), (("hour", "hours", "h"), "time", "h"), (("gram", "grams", "g"), "mass", "g"), (("tonne", "t"), "mass", "t"), (("pound", "lb"), "mass", "lb"),
    (("liter", "litre", "L", "l"), "volume", "l"), (("pascal", "Pa"), "pressure", "Pa"), (("bar",), "pressure", "bar"), (("psi",), "pressure", "psi"), (("volt", "volts", "V"), "voltage", "V"), (("ampere", "amp", "amps", "A"), "current", "A"),
    (("watt", "watts", "W"), "power", "W"), (("joule", "joules", "J"), "energy", "J"), (("newton", "newtons", "N"), "force", "N"), (("hertz", "Hz"), "frequency", "Hz"), (("ohm", "ohms", "Ω"), "resistance", "ohm"), (("mole", "mol"), "amount", "mol"),
    (("byte", "bytes", "B"), "data", "B"), (("bit", "bits"), "data", "bit"), (("candela", "cd"), "intensity", "cd"), (("lux", "lx"), "illuminance", "lx"), (("percent", "%"), "ratio", "%"), (("radian", "rad"), "angle", "rad"),
)
#: marks that carry nothing, and characters that stand for others
MARKS = ("degrees", "degree", "deg.", "deg", "°", "º", "˚", ".", "_", "-", "*", "·", "×", "(", ")", "[", "]")
SIGNS = {"℃": "°C", "℉": "°F", "K": "K", "−": "-", "⁻": "-", "¹": "1", "²": "2", "³": "3", "⁰": "0", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁺": "+", "μ": "µ"}
#: powers of ten as they are written before or after a unit
FACTORS = {"/10": -1, "/ 10": -1, "/100": -2, "/ 100": -2, "/1000": -3, "0.1": -1, "0,1": -1, "0.01": -2, "0.001": -3, "1/10": -1, "10^-1": -1, "10-1": -1, "x10": 1, "10": 1, "100": 2, "1000": 3}
#: written right after the root, with or without a sign of power
EXPONENTS = {f"{power}{sign}{n}": -n if sign == "-" else n for power in ("", "^", "**") for sign in ("", "+", "-") for n in range(10)}
#: cost of each kind of piece; letters in another case than a symbol is written in cost CASE on top
COST = {"name": 1.0, "symbol": 2.0, "root": 1.0, "mark": 0.1, "factor": 1.0, "exponent": 1.0, "space": 0.0}
CASE = 0.5
#: share of readings of the field's own dimension before the label is seen; the other dimensions share the rest
PRIOR = 0.97
KEPT = 8  #: meanings held at each place of a label, the cheapest ones


def _trie(words) -> dict:
    """words: (text, payload); a text may have several."""
    top: dict = {}
    for text, payload in words:
        node = top
        for ch in text.lower():
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((text, payload))
    return top


def _ends(trie: dict, low: str, text: str, at: int):
    """What of the trie starts at `at`: (end, payload, cost of its case)."""
    i = at
    while i < len(low) and low[i] in trie:
        trie = trie[low[i]]
        i += 1
        for word, payload in trie.get("", ()):
            yield i, payload, CASE if len(word) <= 2 and text[at:i] != word else 0.0


_PREFIX = _trie([(w, (p, k)) for name, symbol, p in PREFIXES for w, k in ((name, "name"), (symbol, "symbol"))])
_ROOT = _trie([(w, (dimension, name)) for words, dimension, name in ROOTS for w in words])
_MARK, _FACTOR, _EXPONENT = _trie((w, w) for w in MARKS), _trie(FACTORS.items()), _trie(EXPONENTS.items())
_DIMENSIONS = frozenset(d for _, d, _ in ROOTS)


@lru_cache(maxsize=65536)
def readings(label: str | None, dimension: str = "temperature") -> tuple[tuple[tuple, float], ...]:
    """((dimension, root, power of ten of one unit, exponent), weight) of every reading of a label, heaviest first; the weights add up to 1.

    A reading's weight is exp(-cost) times the prior of its dimension in a field of `dimension`. ``C/10``, ``0.1 C``, ``dC``, ``decicelsius`` are read as ('C', -1, 1), ``mm²``
    as ('m', -6, 2): an exponent holds for the prefix too. Null, empty and unreadable labels have no reading. Very long labels are read whole, in time linear in
    their length.
    """
    if label is None:
        return ()
    text = "".join(SIGNS.get(ch, ch) for ch in label).strip()
    low = text.lower()
    if len(low) != len(text):
        text = low
    # best[i][state]: {meaning: cost}; state 0 before the root, 1 after a prefix that waits for its root, 2 right after the root, 3 after root and exponent, if any
    best: list[dict] = [{} for _ in range(len(text) + 1)]
    best[0] = {0: {(None, 0, 0, 1): 0.0}}

    def put(i: int, state: int, meaning: tuple, cost: float) -> None:
        at = best[i].setdefault(state, {})
        if cost < at.get(meaning, math.inf):
            at[meaning] = cost
            if len(at) > KEPT:
                del at[max(at, key=at.get)]

    for i in range(len(text)):
        for state, meanings in list(best[i].items()):
            after = 3 if state == 2 else state
            for (root, factor, prefix, exponent), cost in list(meanings.items()):
                if text[i].isspace() and state != 1:
                    put(i + 1, after, (root, factor, prefix, exponent), cost + COST["space"])
                if state != 1:
                    for j, w, _ in _ends(_MARK, low, text, i):
                        put(j, state if w in (")", "]") else after, (root, factor, prefix, exponent), cost + COST["mark"])
                    for j, power, _ in _ends(_FACTOR, low, text, i):
                        put(j, after, (root, factor + power, prefix, exponent), cost + COST["factor"])
                if state == 0:
                    for j, (power, kind), case in _ends(_PREFIX, low, text, i):
                        put(j, 1, (root, factor, power, exponent), cost + COST[kind] + case)
                if state in (0, 1):
                    for j, unit, case in _ends(_ROOT, low, text, i):
                        put(j, 2, (unit, factor, prefix, exponent), cost + COST["root"] + case)
                if state == 2:
                    for j, power, _ in _ends(_EXPONENT, low, text, i):
                        if not text[j : j + 2].lstrip(".,")[:1].isdigit():  # else it begins a longer number
                            put(j, 3, (root, factor, prefix, power), cost + COST["exponent"])
        best[i] = {}
    found: dict[tuple, float] = {}
    for state in (2, 3):
        for (root, factor, prefix, exponent), cost in best[len(text)].get(state, {}).items():
            prior = PRIOR if root[0] == dimension else (1 - PRIOR) / (len(_DIMENSIONS) - 1)
            unit = (*root, factor + prefix * exponent, exponent)
            found[unit] = found.get(unit, 0.0) + math.exp(-cost) * prior
    whole = sum(found.values())
    return tuple(sorted(((u, w / whole) for u, w in found.items()), key=lambda x: (-x[1], x[0])))


def read_unit(label: str | None, dimension: str = "temperature") -> tuple[str, int, int] | None:
    """(root, power of ten of one unit of the label, exponent of the root) by the heaviest reading, or None where that is of another dimension."""
    found = readings(label, dimension)
    return found[0][0][1:] if found and found[0][0][0] == dimension else None


def read_label(label: str | None, dimension: str = "temperature") -> tuple[str, int] | None:
    """(root, power of ten), or None where there is none in that dimension; the first power of the root only (see :func:`read_unit`)."""
    unit = read_unit(label, dimension)
    return unit[:2] if unit and unit[2] == 1 else None
