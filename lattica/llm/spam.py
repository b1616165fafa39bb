"""Keyword-stuffed, link-list and tag pages.

One pass cuts every text into units (lines, and sentences within lines) and measures each: the share of
function words, the shares of words and of word pairs that the page repeats, the share of its most frequent words, the
share of characters in links, the share of hash tags, the density of separators, whether the unit's line is a
duplicate, and whether its line has the build of a reference, a table row or a contents line. The measurements
are written once. What is usual is taken from all pages: the median function-word share per language sets what
lacking function words means; the median shares of repeated words, repeated pairs and frequent words, per language and
page length (words repeat more in longer pages), set from where on a unit counts as repeating. A unit is
stuffing if it lacks function words for its language and is repeated, linked, tagged, a duplicate or a
long row of separated keywords. A page is spam if stuffing makes up more than half of its width, a Han character
being twice as wide as others.

A page's language is the one whose function words it has most of. In other scripts, and where the column names a
language without a list here, words of up to three letters stand for function words, as most languages' do.

Defined cases: null, empty and blank texts are no spam (no row in `spam`, a row of zeros in `measured`).
Wrong or missing language codes do not matter where the text has function words of a listed language. Pages of any
length are measured whole. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import cut

FUNCTION_WORDS = {
    "en": "the a an and or but if of to for on at by with from as is are was were be been has have had do does that which who this these those it its we our they their he she not no every each any some than then so because since although while whereas until when how what why there can may will would could should under above below before after without within into over between during through against about up down out only also both such other more most less same here even still".split(),
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber wenn von zu zur zum mit auf aus bei nach für als ist sind war waren wird werden hat haben nicht kein keine keinen jede jeder jedes diese dieser dieses unsere unser wir sie es sich dass während wegen trotz gegen im am".split(),
    "es": "el la los las un una unos unas y o pero si de del al a para por con sin sobre entre como es son era fue ser ha han no que cual este esta estos estas ese esa se su sus nuestra nuestro cada ninguna ninguno otra otro mientras porque cuando en".split(),
    "fr": "le la les un une des du et ou mais si de à pour par avec sans sur comme est sont était a ont ne pas que qui ce cette ces se son sa ses notre nous chaque aucune autre pendant parce quand en dans".split(),
    "it": "il lo la gli le un uno una di del della dei delle da dal in nel nella con su per tra fra e o ma se che non è sono era ha hanno si ci come più anche questo questa quando perché dove ogni ai al alla".split(),
    "pt": "o a os as um uma de do da dos das em no na nos nas por para com sem e ou mas se que não é são foi ser tem ao à mais como este esta isso quando porque entre cada sua seu".split(),
    "nl": "de het een van in op te dat die is zijn was en of maar niet met voor aan door er om bij ook als dan naar wordt worden deze dit hun wij ze heeft hebben over uit".split(),
    "pl": "i w z na do nie że się to jest o jak po ale co za od przez przy dla lub czy oraz są był była które który tym tego także gdy ze".split(),
    "ru": "и в во не на что с со по как это к а из но от для о об у же так за мы они он она его их то все был была были быть или при до если бы также когда чем где эта этот этой".split(),
}
#: The languages a word serves grammar in, and the words that do in the most usual ones.
LANGS_OF: dict[str, tuple] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        LANGS_OF[_w] = (*LANGS_OF.get(_w, ()), _lang)
#: The languages whose function words count on every page.
MAIN = ("en", "de", "es", "fr")
USUAL_WORDS = frozenset(w for lang in MAIN for w in FUNCTION_WORDS[lang])
FUNCTION_OF = {lang: USUAL_WORDS.union(words) for lang, words in FUNCTION_WORDS.items()}
#: Han characters that mostly serve grammar.
HAN_FUNCTION = USUAL_WORDS | frozenset("的了而在与是和被对为于将从其该也以及所到出着过们这那就都不但并或者")
WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿][^\W㐀-鿿]*(?:['’@-][^\W㐀-鿿]+)*")
HAN = re.compile(r"[㐀-鿿]")
HIRAGANA = re.compile(r"[ぁ-ゟ]+")
LINE = re.compile(r"[\r\n\f]+")
#: Where a unit may end; the character itself decides what must follow it.
END = re.compile(r"[.!?。！？；|·•]")
LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)\S+|(?:>>|->|=>|[-–—:])\s*[\w-]+(?:\.[\w-]+)+(?:/\S*)?|\b[\w-]+(?:\.[\w-]+)+/\S*", re.I)
#: What every link has, apart from markup: a dot before a letter.
DOT = re.compile(r"\.[^\W\d_]|://|\.\w+/")
TAG = re.compile(r"[#＃][^\s#＃,;|]+")
SEPARATOR = re.compile(r"[,;|·•/、；，>#*]")
REFERENCE = re.compile(r"\(?\b(?:19|20)\d\d[a-z]?\b\)?.*\d+\s*[-–]\s*\d+|^\s*\[\d+\].*\b(?:19|20)\d\d\b|\(\d+\)\s*,")
ROW = re.compile(r"(?:[\t|]\s*[-+]?\d+(?:[.,]\d+)?\s*%?\s*){2,}")
CONTENTS = re.compile(r"\.{4,}\s*\d+\s*$|^\s*\d+(?:\.\d+)*\.?\s.*\s\d+\s*$")

NAMES = ["chars", "words", "func", "near", "rep", "pair", "top", "link", "tag", "sep", "dup", "built"]
UNITS = "array<struct<chars int, words int, func float, near float, rep float, pair float, top float, link float, tag float, sep float, dup boolean, built boolean>>"
#: A language without a list, or a script without one.
OTHER = "xx"
#: Words of so many letters stand for function words there.
SHORT = 3
#: So many of a page's most frequent words, each so frequent at least, are its frequent words.
TOP, LEAST_TOP = 5, 3
#: A page's share of function words, and their number, from which on it is of one of the other languages.
SURE, SURE_KINDS = 0.15, 5
#: A unit lacks function words below this part of its language's median share.
LACK = 0.5
#: Median shares where a corpus has too few pages of a language to take its own.
USUAL = {"zh": 0.10, OTHER: 0.20, "": 0.30}
LEAST_PAGES = 30
#: From these shares on a unit counts as linked or tagged; as repeating from these on, or from so far above the usual for its page's length.
LINKED, TAGGED = 0.3, 0.3
REPEATED, PAIRED, FREQUENT, ABOVE = 0.5, 0.5, 0.5, 0.15
#: Separators a word, and words, of a row of keywords that do not repeat.
SEPARATED, ROW_WORDS = 0.4, 8


def units_of(line: str) -> Iterator[str]:
    """A line cut after sentence ends that white space follows, after Han ones, and at separators that stand alone."""
    at, n = 0, len(line)
    for m in END.finditer(line):
        k = m.end()
        c = line[k - 1]
        if c in ".!?":
            while k < n and line[k] in '"”)':
                k += 1
            if not (k < n and line[k].isspace()):
                continue
        elif c in "|·•" and not (k < n and line[k].isspace() and k > 1 and line[k - 2].isspace()):
            continue
        if k > at:
            yield line[at:k]
            at = k
    if at < n:
        yield line[at:]


def language(text: str, counts: Counter, total: int, said: str | None) -> tuple[str | None, frozenset | None]:
    """(language, its function words) of a page; the words are None where short ones stand for them."""
    n_han = 0 if text.isascii() else sum(n for w, n in counts.items() if len(w) == 1 and "㐀" <= w <= "鿿")
    if n_han > 0.5 * total:
        kana = frozenset(w for w in counts if HIRAGANA.fullmatch(w))
        if sum(counts[w] for w in kana) > SURE * total:
            return OTHER, kana
        return "zh", HAN_FUNCTION
    hits: Counter = Counter()
    kinds: Counter = Counter()
    for w in counts.keys() & LANGS_OF.keys():
        for lang in LANGS_OF[w]:
            hits[lang] += counts[w]
            kinds[lang] += 1
    # A stray word does not make a page one of a rarer language: so many of that language's function words must make up so much of it.
    sure = [x for x in hits if x in MAIN or hits[x] >= SURE * total and kinds[x] >= SURE_KINDS]
    best = max(sure, key=lambda x: (hits[x], -ORDER[x])) if sure else None
    if not text.isascii() and (not best or hits[best] < 0.05 * total):
        other = sum(n for w, n in counts.items() if w[0] > "ɏ" and not "Ḁ" <= w[0] <= "ỿ")
        if other > 0.5 * total:
            return OTHER, None
    if said and said not in ORDER and said in CODES and (not best or hits[best] < 0.15 * total):
        return OTHER, None
    return best, FUNCTION_OF[best] if best else USUAL_WORDS


ORDER = {lang: k for k, lang in enumerate([*FUNCTION_WORDS, "zh"])}
#: Codes of further languages that a column may name.
CODES = frozenset("ar bg bn ca cs da el et eu fa fi ga gl he hi hr hu hy id is ja ka ko lt lv mk ms mt nb nn no ro sk sl sq sr sv sw ta te th tl tr uk ur vi".split())


def measure(text: str, said: str | None = None) -> tuple[str | None, float, int, tuple, list[tuple]]:
    """(language, function-word share, content words, (shares of repeated words, repeated pairs, frequent words), units) of one page."""
    pieces, line_of = [], []
    for line in LINE.split(text):
        for p in units_of(line):
            if not p.isspace():
                pieces.append(p)
                line_of.append(line)
    build = {}
    spoken, linked = [], []
    linky = "](" in text or "<" in text or DOT.search(text) is not None
    for p in pieces:
        bare = LINK.sub(" ", p) if linky and ("](" in p or "<" in p or DOT.search(p)) else p
        linked.append(len(p) - len(bare) + bare.count(" ") - p.count(" ") if bare is not p else 0)
        spoken.append(WORD.findall(bare.lower()))
    counts = Counter(chain.from_iterable(spoken))
    lines = Counter(p.strip() for p in pieces)
    total = sum(counts.values())
    lang, func_of = language(text, counts, total, said)
    zh = lang == "zh"
    if func_of is None:
        func_of = frozenset(w for w in counts if len(w) <= SHORT)
    pairs = Counter(chain.from_iterable(zip(w, w[1:], strict=False) for w in spoken))
    size = [len(w) for w in spoken]
    func = [sum(map(func_of.__contains__, w)) for w in spoken]
    held = sum(func)
    content = {w: n for w, n in counts.items() if w not in func_of}
    n_content = total - held
    frequent = {w for w, n in sorted(content.items(), key=lambda x: -x[1])[:TOP] if n >= LEAST_TOP} if not zh else frozenset()
    n_pairs = max(1, sum(pairs.values()))
    usual = (
        sum(n for n in content.values() if n > 1) / max(1, n_content) if not zh else sum(n for n in pairs.values() if n > 1) / n_pairs,
        sum(n for n in pairs.values() if n > 1) / n_pairs,
        sum(content[w] for w in frequent) / max(1, n_content),
    )
    units = []
    for i, p in enumerate(pieces):
        w = spoken[i]
        lo, hi = max(0, i - 2), i + 3
        around = sum(size[lo:hi])
        near = sum(func[lo:hi]) / around if around else 0.0
        own = func[i] / size[i] if size[i] else 0.0
        rep = pair = top = tag = sep = 0.0
        built = dup = False
        if own < 0.3:
            n = size[i]
            if n > 1:
                pair = sum(pairs[x] > 1 for x in zip(w, w[1:], strict=False)) / (n - 1)
            if zh:
                rep = pair
            elif w:
                bare = [x for x in w if x not in func_of]
                if bare:
                    rep = sum(content[x] > 1 for x in bare) / len(bare)
                    top = sum(map(frequent.__contains__, bare)) / len(bare)
            tags = TAG.findall(p)
            tag = sum(map(len, tags)) / len(p)
            sep = len(SEPARATOR.findall(p)) / max(1, n)
            dup = lines[p.strip()] > 1
            line = line_of[i]
            if line not in build:
                build[line] = bool(REFERENCE.search(line) or ROW.search(line) or CONTENTS.search(line))
            built = build[line] and not tags and linked[i] < 0.3 * len(p)
        units.append((len(p) + len(HAN.findall(p)) if zh else len(p), size[i], own, near, rep, pair, top, linked[i] / len(p), tag, sep, dup, built))
    return lang, (held / total if total else 0.0), n_content, usual, units


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32()] * 2 + [pa.float32()] * 8 + [pa.bool_()] * 2
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            langs, share, sizes, usual, flat, ends = [], [], [], [], [], [0]
            for text, said in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lang, f, n, shares, units = measure(text or "", said)
                langs.append(lang)
                share.append(f)
                sizes.append(n.bit_length())
                usual.append(shares)
                flat += units
                ends.append(len(flat))
            cols = list(zip(*flat, strict=True)) or [[]] * len(NAMES)
            struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)
            reps = [pa.array(c, pa.float32()) for c in zip(*usual, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(share, pa.float64()), pa.array(sizes, pa.int32()), *reps, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], names=["id", "said", "lang", "func", "size", "rep", "pair", "top", "units"])


def measured(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(id, lang, func, size, rep, pair, top, units): the measurements of every page, without a shuffle; size counts binary digits of its content words."""
    src = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lower(F.substring(lang, 1, 2)).alias("said"))
    rows = src.mapInArrow(_measure, f"id {src.schema['id'].dataType.simpleString()}, said string, lang string, func double, size int, rep float, pair float, top float, units {UNITS}")
    return rows.withColumn("lang", F.coalesce("lang", F.when(F.col("said").isin(*FUNCTION_WORDS, "zh"), F.col("said")), F.lit(""))).drop("said")


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, least): the function-word share below which a unit lacks them; at most one row per known language."""
    said = rows.where(F.col("func") > 0).groupBy("lang").agg(F.percentile_approx("func", 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("pages"))
    # Where most pages of a language are stuffed, half of the usual share holds.
    return said.select("lang", (F.when(F.col("pages") >= LEAST_PAGES, F.greatest("median", _usual() / 2)).otherwise(_usual()) * LACK).alias("least"))


def _usual() -> Column:
    return F.when(F.col("lang") == "zh", USUAL["zh"]).when(F.col("lang") == OTHER, USUAL[OTHER]).otherwise(USUAL[""])


def expected(rows: DataFrame) -> DataFrame:
    """(lang, size, rep_at, pair_at, top_at): from where on a unit repeats; at most 32 rows per known language.

    The median page's share plus a margin, half of what is left to 1 at most, where enough pages of a language have that length.
    """
    shares = rows.groupBy("lang", "size").agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in ("rep", "pair", "top")), F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    return shares.select("lang", "size", *(F.least(F.col(c) + ABOVE, (F.col(c) + 1) / 2).alias(f"{c}_at") for c in ("rep", "pair", "top")))


def judged(rows: DataFrame) -> DataFrame:
    """(id, lang, share): the share of each page's width in stuffed units."""
    # At most one row per listed language (and 32 lengths): safe to broadcast.
    joined = rows.select("id", "lang", "size", "units").join(F.broadcast(thresholds(rows)), "lang", "left").join(F.broadcast(expected(rows)), ["lang", "size"], "left")
    least = F.coalesce(F.col("least"), _usual() * LACK)
    at = lambda c, floor: F.least(F.greatest(F.coalesce(c, F.lit(floor)), F.lit(floor)), F.lit(1.0))
    joined = joined.select("id", "lang", "units", least.alias("least"), at("rep_at", REPEATED).alias("rep_at"), at("pair_at", PAIRED).alias("pair_at"), at("top_at", FREQUENT).alias("top_at"))

    def stuffed(u):
        again = (u["rep"] >= F.col("rep_at")) | (u["pair"] >= F.col("pair_at")) | (u["top"] >= F.col("top_at"))
        row = (u["sep"] >= SEPARATED) & (u["words"] >= ROW_WORDS)
        loud = (u["link"] > LINKED) | (u["tag"] > TAGGED) | again | row | (u["dup"] & (u["words"] > 0))
        return loud & ~u["built"] & (F.least(u["func"], u["near"]) < F.col("least"))

    def total(units):
        return F.aggregate(units, F.lit(0), lambda s, u: s + u["chars"])

    all_chars = total(F.col("units"))
    return joined.select("id", "lang", F.when(all_chars > 0, total(F.filter("units", stuffed)) / all_chars).otherwise(F.lit(0.0)).alias("share"))


def spam(df: DataFrame, key: str, text: str, lang: str, more_than: float = 0.5) -> DataFrame:
    """(id, share) of the pages that are mostly stuffing."""
    rows = cut(measured(df.where(F.col(text).isNotNull()), key, text, lang), "pages")
    return judged(rows).where(F.col("share") > more_than).select("id", "share")
