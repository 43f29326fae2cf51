"""Keyword-stuffed pages and link lists.

Whole texts are read in one narrow Arrow pass that yields a dozen numbers a document; thresholds are then calibrated
per language on the numbers of all documents (mergeable quantile sketches) and applied.

A text falls into segments (lines; sentences within a line). A segment is *prose* if it holds function words or reads as
a sentence, *business* if it holds amounts, dates, quantities or numbers of documents, a *link* if it holds an address,
else *bare*: words without anything that makes them a sentence. Top-word, n-gram and duplicate-line shares, separator
density and missing function words are measured over the bare and link segments, so that one or a few ordinary
sentences around a block of keywords do not dilute them, and item lists or open invoices do not count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.plans.lineage import Scratch, spread

#: Common function words of the corpus's languages.
FUNCTION_WORDS = frozenset(
    # English
    "a an the of and or to in is are was were be been has have had will would can could may for that this these those on with we our us not it its "
    "you your by as at from but if so they them their he she his her who which what when where all any no nor do does did there here than then into "
    # German
    "der die das den dem des ein eine einen einem einer eines und oder ist sind war waren wird werden wurde wurden hat haben nicht kein keine keinen zu zum zur "
    "mit für auf aus bei von vom im in an am um als auch noch weil dass ob sich wir uns unser unsere sie ihr ihre ihnen ihren es er bitte bis nach über durch "
    # French
    "le la les un une des du de et ou est sont était sera été a ont n'a pas ne à au aux en dans par pour sur avec sans ce cet cette ces nous vous votre vos notre nos "
    "il elle ils elles que qui si ou où se son sa ses leur leurs encore deux "
    # Indonesian
    "dan atau yang di ke dari untuk pada dengan ini itu adalah akan telah sudah belum tidak bukan kami kita anda saya mohon jika bila apakah oleh sebagai sebesar "
    "dalam setelah sampai hari para juga agar karena merupakan atas kali "
    # Spanish, Italian, Portuguese, Dutch
    "el los las del y o es son por para con sin que se su sus lo il gli i e di da per non che una del della al het een en van is op te met voor niet".split()
)
#: All languages together.
OTHER_LANGUAGE = "other"
#: Limit, by which feature of ordinary texts, at which quantile, times what.
LIMITS = {
    "most_top_word": ("prose_top_word", 0.9, 1.0), "most_top_ngram": ("prose_top_ngram", 0.9, 1.0), "most_duplicate_lines": ("prose_lines", 0.9, 1.0),
    "most_separators": ("prose_separators", 0.75, 1.0), "most_link_share": ("link_share", 0.9, 1.0), "few_function_words": ("function_words", 0.75, 0.8),
}
#: Limits where nothing is known, and the documents that they weigh.
PRIOR = {"most_top_word": 0.5, "most_top_ngram": 0.5, "most_duplicate_lines": 0.3, "most_separators": 0.15, "most_link_share": 0.4, "few_function_words": 0.15}
WEIGHT = 50
#: Share of a text's characters in bare and link segments above which it counts as made of them.
SPAM_SHARE = 0.5
#: The same where addresses are part of them, unless most lines and sentences are links: addresses are long, a
#: few in a short mail can make up half of its characters.
ADDRESS_SHARE = 0.6

_SEGMENTS = re.compile(r"(?<=[.!?;。！？])\s+|[\r\n]+")
_LINK = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"')\]]+", re.I)
# the first address is taken for good, so an unclosed tag with many addresses costs one pass
_ANCHOR = re.compile(r"<a\s(?>[^<>]*?((?:https?://|www\.)[^\s\"'<>]+))[^<>]*+>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_BUSINESS = re.compile(
    r"\b(?:USD|EUR|GBP|IDR|CHF|JPY)\b|[€£]|\d[.,]\d{2}\b|\b\d{1,4}[./-]\d{1,2}[./-]\d{2,4}\b"  # money, dates
    r"|\d+\s+pcs\b|\d\s*[x×@=]\s+\S*\d|;\s*\S*\d+\s*;|@\s*\d",  # quantities and prices
    re.I,
)
#: An item with its quantity at either end, and a labelled value: business unless a product code follows.
_QUANTITY = re.compile(r"^\W*\d{1,3}\s*[x×]?\s+\D|[(,;]\s*\d{1,3}\)?\s*$", re.I)
_LABEL = re.compile(r"^[^:\n]{2,30}:\s*\S")
_SEPARATORS = re.compile(r"[|*;#>•·~+]|,(?!\d)|[_/]\s|\s[–—-]\s|\s{2,}")
_CODE = re.compile(r"\b(?:sku|art|ref|ean|asin)\W*\d{3,}|\b\d{4,}\s*$", re.I)
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_LETTER = re.compile(r"[^\W\d_]")
_SENTENCE_END = re.compile(r"[.!?;。！？؟।…][\s\"'»”)\]]*$")
_MARKS = re.compile(r"[#|/*;>•·~_+,،、，・\n]|\s[-–—]\s|\s{2,}")
_DENSE_SCRIPT = re.compile(r"[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
#: Letters of a tag or keyword on average at most; a letter of scripts without blanks between words counts as three.
TAG_LETTERS = 22

FEATURES = ("n_segments", "n_words", "spam_share", "link_share", "top_word", "top_ngram", "duplicate_lines", "separators", "function_words", "link_lines")
#: The same measured over the sentences of a text: what the limits of its language are taken from.
PROSE = ("prose_top_word", "prose_top_ngram", "prose_lines", "prose_separators")

#: Where a segment of keywords may be cut: a keyword list and a sentence can share one.
_PIECES = re.compile(r"[|•·~]|\s[/–—-]\s|,\s|\s{2,}")
_DIGIT_OR_MONEY = re.compile(r"[\d€£]|(?:USD|EUR|GBP|IDR|CHF|JPY)", re.I)


def _tagged(segment: str) -> bool:
    """Whether a segment in a script without known function words is made of tags: short pieces, no end of a sentence."""
    pieces = [x for x in _MARKS.split(segment) if x and _LETTER.search(x)]
    if _SENTENCE_END.search(segment) and not (len(pieces) > 2 and re.search("[#|•·~]", segment)):
        return False
    letters = len(_LETTER.findall(segment)) + 2 * len(_DENSE_SCRIPT.findall(segment))
    return letters <= TAG_LETTERS * len(pieces)


def _linked(text: str) -> bool:
    return "://" in text or "www." in text or "WWW." in text or "Www." in text


def _spoken(segment: str) -> tuple[str, list[str]]:
    """The segment without addresses, and its words."""
    bare = _LINK.sub(" ", segment) if _linked(segment) else segment
    return bare, _WORD.findall(bare.lower())


def _segments(plain: str) -> list[tuple[str, str, list[str], int]]:
    """(segment, without addresses, words, function words) of lines and sentences.

    A segment in which keywords run into a sentence falls into its pieces; one made of either is left whole.
    """
    out = []
    for raw in _SEGMENTS.split(plain):
        segment = raw.strip()
        if not segment:
            continue
        bare, found = _spoken(segment)
        functional = sum(map(FUNCTION_WORDS.__contains__, found))
        if functional >= 2 and len(found) >= 12 and bare is segment:
            pieces = [(x, *_spoken(x)) for x in map(str.strip, _PIECES.split(segment)) if x]
            counts = [sum(map(FUNCTION_WORDS.__contains__, words)) for _, _, words in pieces]
            # a keyword may hold one of these words ('pas cher'), a sentence holds more
            weak = [bool(words) and (5 * c <= len(words) or c == 1 and len(words) <= 6) for c, (_, _, words) in zip(counts, pieces)]
            if sum(weak) >= 3 and 2 * sum(weak) >= len(pieces) and max(counts) >= 2:
                out += [(x, b, words, 0 if w else c) for (x, b, words), c, w in zip(pieces, counts, weak)]
                continue
        out.append((segment, bare, found, functional))
    return out


class _Repeats:
    """Words, pairs of words, lines and separators of some segments of a text."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.bigrams: Counter = Counter()
        self.lines: Counter = Counter()
        self.separators = 0

    def add(self, segment: str, found: list[str]) -> None:
        # a line that doesn't end as a sentence is set apart by its end
        self.separators += len(_SEPARATORS.findall(segment)) + (_SENTENCE_END.search(segment) is None)
        self.words.update(found)
        self.bigrams.update(zip(found, found[1:]))
        self.lines[" ".join(found) or segment] += 1

    def shares(self) -> tuple[float, float, float, float]:
        """Top five words among all, repeated pairs among all, repeated lines among all, separators for each word."""
        total, pairs, n = sum(self.words.values()), sum(self.bigrams.values()), sum(self.lines.values())
        return (
            sum(c for _, c in self.words.most_common(5)) / total if total >= 10 else 0.0,
            sum(c for c in self.bigrams.values() if c > 1) / pairs if pairs >= 10 else 0.0,
            sum(c - 1 for c in self.lines.values()) / n if n else 0.0,
            self.separators / max(total, n, 1) if n else 0.0,
        )


def features(text: str | None) -> tuple[float, ...]:
    """The numbers of FEATURES and PROSE; all 0 for a null, empty or blank text.

    ``spam_share``: characters of bare and link segments among all; ``link_lines``: link segments among all segments;
    ``function_words``: function words in sentences for six characters of the text. The other shares are measured over
    the bare and link segments, those of PROSE over the sentences.
    """
    if not text or not text.strip():
        return (0.0,) * (len(FEATURES) + len(PROSE))
    plain = _TAG.sub(" ", _ANCHOR.sub(r" \1 ", text)) if "<" in text else text
    whole = kept = linked = n_function = n_linked = 0
    stuffed, prose = _Repeats(), _Repeats()
    segments = _segments(plain)
    often = Counter(tuple(found) for _, _, found, _ in segments)
    lead = Counter(tuple(found[:2]) for _, _, found, _ in segments if 2 < len(found) <= 8)
    for segment, bare, found, functional in segments:
        size = len(segment)
        whole += size
        is_linked = bare is not segment and len(bare) < size
        in_links = sum(map(len, _LINK.findall(segment))) if is_linked else 0
        again = 0 < len(found) <= 4 and often[tuple(found)] > 2 or len(found) >= 12 and len(set(found)) < 0.45 * len(found)
        # one frame filled in again and again
        again = again or 2 < len(found) <= 8 and lead[tuple(found[:2])] > 3 and not _SENTENCE_END.search(segment)
        if in_links and (in_links > 0.4 * size or functional < 2):
            linked += size
            n_linked += 1
        elif not again and (functional >= 2 and functional >= 0.08 * len(found) or functional and len(found) <= 8):
            n_function += functional
            prose.add(segment, found)
            continue
        elif sum(map(len, found)) < 0.4 * (len(bare) - bare.count(" ")) or (_DIGIT_OR_MONEY.search(segment) and _BUSINESS.search(segment)):
            continue
        elif _QUANTITY.search(segment) and not _CODE.search(segment):
            continue
        elif again:
            pass
        elif len(_LATIN.findall(segment)) < 0.5 * len(_LETTER.findall(segment)) and not _tagged(segment):
            prose.add(segment, found)
            continue
        elif _LABEL.search(segment) and not _CODE.search(segment):
            continue
        kept += size
        stuffed.add(segment, found)
    return (
        float(sum(stuffed.lines.values())),
        float(sum(stuffed.words.values())),
        kept / max(whole, 1),
        linked / max(whole, 1),
        *stuffed.shares(),
        min(1.0, 6.0 * n_function / max(whole, 1)),
        n_linked / max(len(segments), 1),
        *prose.shares(),
    )


def page_features(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, ``lang`` (normalised), FEATURES and PROSE of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(2).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(FEATURES + PROSE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in columns)], names=[key, "lang", *FEATURES, *PROSE])

    # only the primary subtag counts: 'de-DE' and ' DE' are German
    language = F.coalesce(F.regexp_extract(F.lower(F.trim(F.col(lang))), r"^([a-z]{2,3})", 1), F.lit(""))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, lang string, " + ", ".join(f"{f} double" for f in FEATURES + PROSE)
    return spread(df.select(F.col(key), language.alias("lang"), F.col(text))).mapInArrow(run, schema)


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, n_docs and the columns of LIMITS): what is unusual among the ordinary texts of each language.

    Quantiles of all documents of a language that are not mostly bare words or links (sketches that merge on the map
    side): how repetitive and how full of separators their sentences are at most, how many links they hold, and how many
    function words those have that are made of sentences (the upper quarter; lists of items and open invoices have few).
    Each limit is the mean of the language's own figure, weighing as many documents as it has, of that of all documents
    (language OTHER_LANGUAGE) and of PRIOR, which weigh WEIGHT documents each: a rare language leans on all others.
    """
    ordinary = measured.where(f"spam_share <= {SPAM_SHARE} and (n_segments > 0 or function_words > 0)")
    names = list(LIMITS)

    def own(df: DataFrame) -> DataFrame:
        at = {n: F.percentile_approx(c, q, 1000) * scale for n, (c, q, scale) in LIMITS.items()}
        return df.agg(F.count(F.lit(1)).alias("n_docs"), *(x.alias(n) for n, x in at.items()))

    def leaning(n, mine, prior):
        return (n * mine + WEIGHT * prior) / (n + WEIGHT)

    rest = own(ordinary).first()  # one row of numbers
    every = {n: leaning(rest["n_docs"], rest[n] or 0.0, PRIOR[n]) for n in names}
    each = own(ordinary.groupBy("lang")).select("lang", "n_docs", *(leaning(F.col("n_docs"), F.col(n), F.lit(every[n])).alias(n) for n in names))
    schema = "lang string, n_docs bigint, " + ", ".join(f"{n} double" for n in names)
    return each.unionByName(measured.sparkSession.createDataFrame([(OTHER_LANGUAGE, rest["n_docs"], *every.values())], schema))


def _verdict() -> Column:
    repeated = F.lit(False)
    for feature in ("top_word", "top_ngram", "duplicate_lines", "separators", "link_share"):
        repeated = repeated | (F.col(feature) > F.col(f"most_{feature}"))
    enough = (F.col("n_words") >= 8) | (F.col("n_segments") >= 3) | (F.col("link_share") >= 0.6)
    mostly = (F.col("spam_share") > SPAM_SHARE) & ((F.col("link_share") < 0.2) | (F.col("link_lines") > SPAM_SHARE) | (F.col("spam_share") > ADDRESS_SHARE))
    return mostly & enough & repeated & (F.col("function_words") <= F.col("few_function_words"))


def stuffed_pages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key`` of the documents most of whose text is repeated keywords, links or product tags.

    Null, empty and blank texts are none. Tags of languages are read without case and region; a language of which no
    ordinary text is there is judged by the limits of all documents. The table of limits has a row for each language and
    is joined by broadcast: two letters to three make at most 18,252 of them.
    """
    measured = Scratch(df.sparkSession, "pages").keep(page_features(df, key, text, lang))
    limits = thresholds(measured)
    rest = limits.where(F.col("lang") == OTHER_LANGUAGE).first()  # one row of numbers
    known = limits.where(F.col("lang") != OTHER_LANGUAGE).select("lang", F.struct(*LIMITS).alias("known"))
    judged = measured.join(F.broadcast(known), "lang", "left").withColumns({n: F.coalesce(F.col("known")[n], F.lit(rest[n])) for n in LIMITS})
    return judged.where(_verdict()).select(key)
