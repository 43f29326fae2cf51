"""Comparing two names typed by people: folding, legal forms, abbreviations, initials, typos, order of parts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import groupby

# Legal forms and how they are spelled out, titles and addressees before a name, short forms of first names.
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "llc": "llc", "plc": "plc", "corp": "corp", "corporation": "corp",
    "gmbh": "gmbh", "mbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "ug": "ug", "kg": "kg", "ohg": "ohg", "sarl": "sarl", "sas": "sas",
    "sa": "sa", "srl": "srl", "spa": "spa", "bv": "bv", "nv": "nv", "pte": "pte", "pty": "pty", "pt": "pt", "tbk": "tbk", "cv": "cv",
    "ab": "ab", "oy": "oy", "aps": "aps", "kft": "kft", "sdn": "sdn", "bhd": "bhd",
}
TITLES = frozenset("mr mrs ms miss dr prof professor dipl ing mag herr frau hr fr mme mlle monsieur madame sig sra sr bapak ibu attn attention zhd".split())
SHORT_NAMES = {
    "alex": "alexander", "sasha": "alexander", "sascha": "alexander", "al": "alexander", "theo": "theodore", "ted": "theodore", "tina": "christina", "chris": "christina",
    "dora": "dorothea", "thea": "dorothea", "dot": "dorothea", "sanna": "susanna", "sue": "susanna", "susi": "susanna", "nell": "eleanor", "ellie": "eleanor", "nora": "eleanor",
    "will": "william", "bill": "william", "billy": "william", "fritz": "friedrich", "fred": "friedrich", "mike": "michael", "mick": "michael",
    "rick": "richard", "dick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bert": "robert", "hans": "johannes", "hannes": "johannes",
    "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "greta": "margaret", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth",
    "sepp": "josef", "joe": "josef", "jupp": "josef", "kathi": "katharina", "kate": "katharina", "katja": "katharina", "paco": "francisco", "pancho": "francisco",
    "kiko": "francisco", "memo": "guillermo", "guille": "guillermo",
}
#: Dearest way in which two spellings may differ and still be one name.
MAX_COST = 4.5

_CARE_OF = re.compile(r"\bc\s*/\s*o\b", re.I)
_PART = re.compile(r"[^\W_]+")


def fold(name: str) -> str:
    """Lower case without accents; ligatures and sharp s spelled out."""
    text = unicodedata.normalize("NFKD", name.casefold().replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("œ", "oe"))
    return "".join(c for c in text if not unicodedata.combining(c))


@lru_cache(100_000)
def parse(name: str) -> tuple[tuple[str, ...], str]:
    """(parts of the name proper in order, legal form).

    Single letters in a row are one part (an acronym or a dotted legal form); titles and addressees are dropped.
    """
    raw = _PART.findall(_CARE_OF.sub(" ", fold(name)))
    parts: list[str] = []
    for single, run in groupby(raw, lambda p: len(p) == 1):
        # an initial before a dotted legal form belongs to the name: 'n b v' is n and bv
        parts += _split_legal("".join(run)) if single else run
    legal = sorted({LEGAL[p] for p in parts if p in LEGAL})
    core = [p for p in parts if p not in LEGAL and p not in TITLES and p != "gesellschaft"]
    if not core:
        core = [p for p in parts if p not in TITLES] or parts
        legal = []
    return tuple(core), "".join(legal)


def _split_legal(part: str) -> list[str]:
    if len(part) > 2 and part not in LEGAL:
        for i in range(1, len(part) - 1):
            if part[i:] in LEGAL:
                return [part[:i], part[i:]]
    return [part]


def near(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart (or equal)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb or ra == rb[1:] or ra[1:] == rb[1:] or len(ra) > 1 and len(rb) > 1 and ra[0] == rb[1] and ra[1] == rb[0] and ra[2:] == rb[2:]


def _short_for(a: str, b: str) -> bool:
    """Whether ``a`` abbreviates ``b``: the same first letter, all its letters in b in order, at least two fewer."""
    if not 2 <= len(a) <= len(b) - 2 or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


@lru_cache(200_000)
def part_cost(a: str, b: str) -> float | None:
    """What it takes to read two parts as one; None if they can't be.

    A part that begins with + is two parts of a name written together: it must be the whole of the other, or short for it.
    """
    if a == b:
        return 0.0
    if a[0] == "+" or b[0] == "+":
        both, one = (a[1:], b) if a[0] == "+" else (b[1:], a)
        return 0.5 if both == one else 1.0 if near(both, one) else 1.25 if _short_for(both, one) else None
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 1.5 if b[0] == a else None
    if len(a) >= 3 and near(a, b):
        return 1.0
    if SHORT_NAMES.get(a) == b:
        return 1.0
    if b.startswith(a) and len(a) >= 2 and len(b) - len(a) >= 2:
        return 1.0
    if _short_for(a, b):
        return 1.25
    if len(a) >= 3 and any(_short_for(a[:i] + a[i + 1 :], b) for i in range(1, len(a))):  # abbreviated with a typo
        return 2.0
    if len(a) >= 8 and any(near(a[:i] + a[i + 1 :], b) or near(a, b[:i] + b[i + 1 :]) for i in range(len(a))):
        return 2.0
    return None


def _align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int, int] | None:
    """Cheapest one-to-one reading of all parts of ``a`` (the shorter) in ``b``: (cost, exact or near parts, parts left).

    Equal parts are read as each other; so few others can be within MAX_COST that they are tried in every order.
    """
    left, rest, strong = list(b), [], 0
    for part in a:
        if part in left:
            left.remove(part)
            strong += len(part) >= 3
        else:
            rest.append(part)
    found = _paired(tuple(rest), tuple(left), MAX_COST)
    return None if found is None else (found[0], found[1] + strong, found[2])


def _paired(a: tuple[str, ...], b: tuple[str, ...], budget: float) -> tuple[float, int, int] | None:
    """``_align`` of unequal parts for at most ``budget``."""
    if not a:
        return 0.0, 0, len(b)
    best = None
    # no two unequal parts are cheaper than a half
    for j, part in enumerate(b if 0.5 * len(a) <= budget else ()):
        c = part_cost(a[0], part)
        if c is None or c > budget:
            continue
        rest = _paired(a[1:], b[:j] + b[j + 1 :], budget - c)
        if rest is not None:
            found = (c + rest[0], rest[1] + (c <= 1.0 and min(len(a[0]), len(part)) >= 3), rest[2])
            if best is None or found[0] < best[0]:
                best = found
    return best


def _merged(parts: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [parts[:i] + ("+" + parts[i] + parts[i + 1],) + parts[i + 2 :] for i in range(len(parts) - 1)]


def acronyms(parts: tuple[str, ...]) -> list[str]:
    """Initials of all parts, and of the first three where there are more (a trade of two words has one letter)."""
    initials = "".join(p[0] for p in parts)
    return [initials, *([initials[:3]] if len(initials) > 3 else [])] if len(initials) > 1 else []


def name_cost(a: tuple[tuple[str, ...], str], b: tuple[tuple[str, ...], str]) -> float | None:
    """How differently two parsed names spell one name; None if they name different ones.

    Parts may come in any order. They agree if equal, one typo apart, an initial, an abbreviation or a short first name;
    one part may be left out of one side if two others agree. Legal forms agree or are left out. Initials of all parts
    with the same legal form are an acronym.
    """
    (pa, la), (pb, lb) = a, b
    if la and lb and la != lb:
        return None
    if len(pa) > len(pb):
        (pa, la), (pb, lb) = b, a
    legal = 0.0 if la == lb else 0.5
    if pa == pb:
        return legal
    if "".join(sorted(pa)) == "".join(sorted(pb)) or "".join(pa) == "".join(pb):
        return 0.5 + legal
    if len(pa) == 1:
        if la and la == lb and pa[0] in acronyms(pb):
            return 3.5
        if near("".join(pa), "".join(pb)) and len(pa[0]) >= 8:
            return 1.5 + legal
    best = None
    merged = [(m, y) for x, y in ((pa, pb), (pb, pa)) if len(x) == len(y) + 1 for m in _merged(x)]
    for x, y in [(pa, pb), *merged]:
        if len(y) - len(x) > 1:
            continue
        found = _align(x, y)
        if found is None:
            continue
        cost, strong, left = found
        if left and len(x) < 2 or not strong or left and strong < 2 and len(x) < 3:
            continue
        cost += 2.0 * left + legal
        if cost <= MAX_COST and (best is None or cost < best):
            best = cost
    return best
