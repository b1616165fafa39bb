"""Variant spellings of names linked to one entity.

1. Names are parsed once per distinct (scope, place, spelling): case, accents, titles, footnote marks and order
   are set aside; persons give words and initials, things give words and designations (versions,
   years, sizes, splits). Glued words are cut where a capital follows small letters; the whole spelling without
   gaps and the words as they were before cutting are kept as further forms. A scope is what may be linked at all (persons, or things of one type); a place is
   what tells namesakes apart (a person's institution; null where unknown).
2. Distinct words of a scope are joined on their q-grams: each word offers its rarest padded q-grams, as many as
   an edit can destroy plus one (prefix filter), with their positions; candidates within one edit
   (insertion, deletion, replacement, swap), two among persons of one place, are variants of one another.
3. A word's weight is log(1 + N / df), df over all its variants and short forms, so a rare typo of a common
   word stays light. Candidates are bounded by what verification accepts. Of two matching things one has its
   heaviest word matched, so heaviest words meet all words, their variants included. Two matching persons have two words
   matched, so pairs of words are keys, each word also as its commoner variants and full forms; or one, and initials that
   cover all else, so a word is a key with a letter that is an initial on at least one side (see _keys). One given
   name beside surnames of one first letter brings nobody together.
   Persons meet in one place, or where a place is unknown.
4. A pair is verified by the soft weighted cosine of its words, where each word counts with its best partner
   (equal, variant, nickname, abbreviation, acronym, initial), and must not contradict itself: other given
   names, initials or designations. Things whose spellings differ by gaps alone are the same.
5. Links within known places are closed transitively; a record of unknown place joins the one group it
   matches, and none if it matches namesakes in several places; what is left unknown is linked among itself.

Defined cases: null and blank names, and names without a letter, are linked to nothing. A thing's name of designations
alone ('GPT4') is one word. Repeated rows and equal
spellings are one record. An id with several spellings belongs to the groups of all of them. Ties do not
arise. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from math import sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.components import components
from lattica.plans.tables import cut, drop, plan_bytes, settled, swept

THETA = 0.6
GRAM = 4
#: A swap touches q + 1 grams, any other edit at most q.
DESTROYED = GRAM + 1
LEAST_LETTERS = 4
#: Places of grams that are joined together, more than two edits can move them.
STRETCH = 5
#: Counters of how frequent grams are.
COUNTERS = 1 << 16
#: Grams are joined in so many parts at most, one for so many bytes of them, so that only a part is on disk at a time.
PARTS = 8
PART_BYTES = 1 << 20
#: Words of so many letters may differ by more than one edit.
LONG_LETTERS = 7

TITLES = frozenset("dr prof professor doctor mr mrs ms miss sir phd md msc jr sr herr frau dipl ing".split())
#: Given names and their short forms; the first of a line stands for all.
NICKNAMES = """
alexander alex sasha sandy xander al
alexandra sasha alex lexi
andrew andy drew
anthony tony
barbara barb babs
benjamin ben benny benji
catherine cathy kate katie cat
charles charlie chuck chas
christina chris tina christine
christopher chris kit topher
daniel dan danny dani
daniela dani dany
david dave davy
deborah deb debbie debra
dmitri dima mitya
donald don donny
dorothy dot dottie
edward ed eddie ted teddy ned
elizabeth liz beth betty lizzy eliza libby
emily em emmy
florence flo
francis frank frankie
frederick fred freddy
friedrich fritz fred
gabriel gabe
gerald gerry jerry
giovanni gianni vanni
gregory greg gregor
henry harry hank
isabella bella izzy
jacob jake
james jim jimmy jamie
jennifer jen jenny
jessica jess jessie
joanna jo joey jojo
john jack johnny
jonathan jon jonny
jose pepe
joseph joe joey jo
joshua josh
judith judy
katherine kate kathy katie kat kathryn kitty
kenneth ken kenny
laurence larry laurie
leonard leo len lenny
margaret meg maggie peggy marge greta
maria mary
matthew matt matty
michael mike mick mickey misha
nathaniel nathan nate nat
nicholas nick nicky
pamela pam
patricia pat patty trish tricia
patrick pat paddy
peter pete
philip phil pip
philippa pip pippa
raymond ray
rebecca becky becca
richard rick dick rich richie
robert rob bob robbie bobby bert
ronald ron ronnie
samantha sam sammy
samuel sam sammy
sarah sally sadie
stephen steve
steven steve
susanna sue susan susie suzy
theodore ted theo
theresa terry tess
thomas tom tommy
timothy tim timmy
valentina val
victoria vicky tori vic
vincent vince vinny
virginia ginny
walter walt wally
william will bill billy willy liam
zachary zach zack
zoe zo
""".strip().splitlines()  # fmt: skip
SHORT_NAMES = frozenset("jo ed al bo li wu xu yu ma hu he ho ng an wei ana zoe".split()) | {w for line in NICKNAMES for w in line.split()}
STANDS: dict[str, frozenset] = {}
for _line in NICKNAMES:
    _full, *_shorts = _line.split()
    for _w in (_full, *_shorts):
        STANDS[_w] = STANDS.get(_w, frozenset()) | {_full}

#: What sets one version, size or part of a thing apart from another.
DESIGNATIONS = frozenset("xs xxs xl xxl xxxl base large small tiny mini micro nano medium big huge giant lite light pro plus max ultra dev test train valid validation ii iii iv vi vii viii ix alpha beta gamma cased uncased".split())
STOP = frozenset("the of and for".split())
#: Words that most institutions share, beside the ones their names differ by.
PLACE_WORDS = frozenset("university univ universitat universidad universite institute inst institut instituto technology tech technical college coll computing comp research res laboratory laboratories lab labs department dept school faculty division centre center science sciences sci computer informatics data main campus".split())
WORD = re.compile(r"[^\W_]+")
MARKS = re.compile(r"[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡§¶#]+|\b\d+(?:\s*,\s*\d+)*\b")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c))


def place_of(affiliation: str | None) -> str | None:
    """The words an institution's name differs by, from the part of the affiliation that names it; null where none is left."""
    if not affiliation:
        return None
    parts = re.split(r"[,;(]", fold(affiliation))
    best, best_named = [], False
    for part in parts:
        all_words = WORD.findall(part)
        own = [w for w in all_words if w not in PLACE_WORDS and w not in STOP]
        if own and (not best or (len(own) < len(all_words) and not best_named)):
            best, best_named = own, len(own) < len(all_words)
    return " ".join(sorted(best)) or None


def person(name: str) -> tuple[list[str], list[str]]:
    """(words, initials) of a person's name in any order."""
    words, initials = [], []
    raw = [w for w in re.split(r"[\s.,;\-–‐'’_/()]+", MARKS.sub(" ", name)) if w]
    shouting = all(w.upper() == w for w in raw if len(w) > 3)
    for w in raw:
        f = "".join(WORD.findall(fold(w)))
        if not f or f in TITLES:
            continue
        if len(f) == 1:
            initials.append(f)
        elif len(f) == 2 and f not in SHORT_NAMES or len(f) == 3 and f not in SHORT_NAMES and (w.isupper() and not shouting and not words == [] or not re.search("[aeiouy]", f)):
            initials += list(f)
        else:
            words.append(f)
    return words, initials


def uncased(word: str) -> list[str]:
    """The parts of a word of a name, cut where a capital follows two or more letters of which the last is small."""
    cuts = [k for k in range(2, len(word)) if word[k].isupper() and word[k - 1].islower() and word[k - 2].isalpha()]
    return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)]


def _thing_text(name: str) -> str:
    """A thing's name without the acronym that repeats it in brackets at the end."""
    m = re.search(r"\(\s*([a-z]{2,6})\s*\)\s*$", name, re.I)
    if m and sum(len(uncased(w)) for w in WORD.findall(name[: m.start()])) >= len(m.group(1)) - 1:
        return name[: m.start()]
    return name


def thing(name: str) -> tuple[list[str], list[str]]:
    """(words, designations) of a thing's name."""
    words, marks = [], []
    for w in (x for raw in WORD.findall(unicodedata.normalize("NFC", _thing_text(name))) for part in uncased(raw) for x in WORD.findall(fold(part))):
        if any(c.isdigit() for c in w) or w in DESIGNATIONS:
            marks.append(w)
        elif w not in STOP:
            words.append(w)
    if not words and any(c.isalpha() for m in marks for c in m):
        words = ["".join(marks)]
    return words, sorted(marks)


def glued(name: str) -> list[str]:
    """Further forms of a thing's name: the whole spelling without gaps first, then each word that thing() cuts."""
    raw = WORD.findall(unicodedata.normalize("NFC", _thing_text(name)))
    raw = raw[1:] if len(raw) > 1 and fold(raw[0]) == "the" else raw
    join = lambda w: "".join(WORD.findall(fold(w)))
    first = uncased(raw[0]) if raw else []
    whole = "".join(map(join, first[1:] if len(first) > 1 and fold(first[0]) == "the" else first))
    for w in map(join, raw[1:]):
        # Between digits the gap counts: 81.7 is not 8.17.
        whole += "." + w if whole[-1:].isdigit() and w[:1].isdigit() else w
    return list(dict.fromkeys([whole, *(join(w) for w in raw if len(uncased(w)) > 1)]))


def near(a: str, b: str, most: int = 1) -> int:
    """Edits between two words, a swap counting as one; most + 1 if more than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y))
            if before2 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            now[j] = v
        if min(now) > most:
            return most + 1
        before2, before = before, now
    return min(before[-1], most + 1)


def likeness(a: str, b: str, edits: int) -> float:
    """1 for equal words, less for variants, 0 for others."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < LEAST_LETTERS:
        return 0.0
    most = edits if min(len(a), len(b)) >= LONG_LETTERS else 1
    n = near(a, b, most)
    return 0.0 if n > most else 0.95 if n == 1 else 0.85


def same_given(a: str, b: str) -> bool:
    """Whether one is a short form of the other."""
    x, y = STANDS.get(a), STANDS.get(b)
    return bool(x and y and x & y)


def _pair_up(a: list[str], b: list[str], score) -> tuple[list[tuple[int, int, float]], list[int], list[int]]:
    """Greedy best matching; (pairs, left of a, left of b)."""
    options = sorted(((s, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := score(x, y)) > 0), reverse=True)
    used_a, used_b, pairs = set(), set(), []
    for s, i, j in options:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            pairs.append((i, j, s))
    return pairs, [i for i in range(len(a)) if i not in used_a], [j for j in range(len(b)) if j not in used_b]


def match_persons(a: tuple, b: tuple, wa: dict, wb: dict, edits: int) -> float:
    """Soft weighted cosine of two persons' names, or 0 if they contradict each other."""
    (words_a, init_a), (words_b, init_b) = a, b
    pairs, left_a, left_b = _pair_up(words_a, words_b, lambda x, y: likeness(x, y, edits) or (0.95 if same_given(x, y) else 0.0))
    if not pairs:
        return 0.0
    if left_a and left_b:
        # Initials cover words crosswise ('Hiroshi T. Hapasort', 'Hiroshi H. Tigalols'): only the heaviest word tells then.
        top_a, top_b = max(wa.get(w, 1.0) for w in words_a), max(wb.get(w, 1.0) for w in words_b)
        if not any(wa.get(words_a[i], 1.0) >= top_a or wb.get(words_b[j], 1.0) >= top_b for i, j, _ in pairs):
            return 0.0
    init_a, init_b, dot = list(init_a), list(init_b), 0.0

    def spend(word: str, initials: list[str]) -> bool:
        for c in (word[0], *(s[0] for s in STANDS.get(word, ()))):
            if c in initials:
                initials.remove(c)
                return True
        return False

    total_a = total_b = 0.0
    for i, j, s in pairs:
        x, y = wa.get(words_a[i], 1.0), wb.get(words_b[j], 1.0)
        dot += x * y * s
        total_a += x * x
        total_b += y * y
    for i in left_a:
        if not spend(words_a[i], init_b):
            return 0.0
    for j in left_b:
        if not spend(words_b[j], init_a):
            return 0.0
    for c in list(init_a):
        if c in init_b:
            init_a.remove(c)
            init_b.remove(c)
    if init_a and init_b:
        return 0.0
    return dot / sqrt(total_a * total_b)


def _abbreviates(short: str, long: str) -> bool:
    """Whether a shorter word can stand for a longer one: its first letter, then letters of it in order."""
    if len(short) >= len(long) or len(short) < 2 or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def _glue(words: list[str], other: list[str]) -> list[str]:
    """The words with each run that the other name has as one word put together."""
    out, at = [], 0
    whole = {w for w in other if len(w) > 1} - set(words)
    while at < len(words):
        end = next((j for j in range(len(words), at + 1, -1) if "".join(words[at:j]) in whole), at + 1)
        out.append("".join(words[at:end]))
        at = end
    return out


def match_things(a: tuple, b: tuple, wa: dict, wb: dict) -> float:
    """Soft weighted cosine of two things' names, or 0 if they contradict each other."""
    (words_a, marks_a, *more_a), (words_b, marks_b, *more_b) = a, b
    if more_a and more_b and more_a[0][0] == more_b[0][0]:
        return 1.0
    if marks_a != marks_b:
        return 0.0
    if (len(words_a) == 1) != (len(words_b) == 1) and (s := likeness("".join(words_a), "".join(words_b), 1)):
        return s
    words_a, words_b = _glue(words_a, words_b), _glue(words_b, words_a)
    # A run put together weighs what the other name's word does.
    wa, wb = {**{w: wb[w] for w in words_a if w in wb}, **wa}, {**{w: wa[w] for w in words_b if w in wa}, **wb}
    pairs, left_a, left_b = _pair_up(words_a, words_b, lambda x, y: likeness(x, y, 1))
    if not pairs:
        return 0.0
    heavy = max(words_a, key=lambda w: wa.get(w, 1.0)), max(words_b, key=lambda w: wb.get(w, 1.0))
    if not any(words_a[i] == heavy[0] or words_b[j] == heavy[1] for i, j, _ in pairs):
        return 0.0
    dot = total_a = total_b = 0.0
    for i, j, s in pairs:
        x, y = wa.get(words_a[i], 1.0), wb.get(words_b[j], 1.0)
        dot += x * y * s
        total_a += x * x
        total_b += y * y
    rest_a, rest_b = [words_a[i] for i in left_a], [words_b[j] for j in left_b]
    if rest_a and rest_b:
        more, rest_a2, rest_b2 = _pair_up(rest_a, rest_b, lambda x, y: 0.9 if _abbreviates(x, y) or _abbreviates(y, x) else 0.0)
        if rest_a2 or rest_b2:
            for one, other in ((rest_a, rest_b), (rest_b, rest_a)):
                if len(one) == 1 and len(one[0]) >= 2 and _acronym(one[0], other):
                    break
            else:
                return 0.0
    elif rest_a or rest_b:
        return 0.0
    return dot / sqrt(total_a * total_b)


def _acronym(short: str, words: list[str]) -> bool:
    """Whether `short` is made of the words' first letters, little words' letters between them allowed."""
    firsts = [w[0] for w in words]
    if len(firsts) < 2 or len(short) > len(firsts) + 2 or short[0] != firsts[0]:
        return False
    rest = iter(short)
    return all(c in rest for c in firsts) and len(short) - len(firsts) <= 2


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scope, human, name, where) to records; those of scopes marked human take people's names. `bare` is the record of the name without its place."""
    for batch in batches:
        rec, bare, words, inits, forms, place = [], [], [], [], [], []
        keep = []
        for k, (scope, human, name, where) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            w, i = person(name) if human else thing(name)
            if not w:
                continue
            p = place_of(where)
            keep.append(k)
            words.append(w)
            inits.append(i)
            forms.append([] if human else glued(name))
            place.append(p)
            for ids, where_known in ((rec, p or ""), (bare, "")):
                ids.append(md5("\x1f".join((scope, where_known, " ".join(w), " ".join(i), " ".join(forms[-1]))).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
        if keep:
            part = batch.take(pa.array(keep))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("scope"), part.column("human"), part.column("name"), part.column("where"), pa.array(rec, pa.binary()), pa.array(bare, pa.binary()), pa.array(words, strings), pa.array(inits, strings), pa.array(forms, strings), pa.array(place, pa.string())], names=["scope", "human", "name", "where", "rec", "bare", "words", "inits", "forms", "place"])


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, edits = (batch.column(c).to_pylist() for c in ("a", "b", "edits"))
        kept = batch.filter(pa.array([likeness(*x) > 0 for x in zip(a, b, edits, strict=True)], pa.bool_()))
        a, b = kept.column("a"), kept.column("b")
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([kept.column("scope")] * 2), pa.concat_arrays([a, b]), pa.concat_arrays([b, a])], names=["scope", "a", "b"])


def _grams(token: str) -> list[tuple[str, int]]:
    padded = "^" * (GRAM - 1) + token + "$" * (GRAM - 1)
    return [(padded[i : i + GRAM], i) for i in range(len(token) + GRAM - 1)]


def _slot(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % COUNTERS


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        np.add.at(counts, [_slot(g) for token in batch.column("token").to_pylist() for g, _ in _grams(token)], 1)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots])], names=["slot", "n"])


def _prefix(counts: np.ndarray):
    """(scope, token, edits, gram, pos): of each word as many of its rarest grams as its edits can destroy, and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, grams, places = [], [], []
            for k, (token, edits) in enumerate(zip(batch.column("token").to_pylist(), batch.column("edits").to_pylist(), strict=True)):
                ranked = sorted((counts[_slot(g)], g, i) for g, i in _grams(token))[: edits * DESTROYED + 1]
                for n, g, i in ranked:
                    if n > 1:  # what is unique meets nothing
                        src.append(k)
                        grams.append(g)
                        places.append(i)
            at = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("scope", "token", "edits")), pa.array(grams, pa.string()), pa.array(places, pa.int32())], names=["scope", "token", "edits", "gram", "pos"])

    return run


def variants(tokens: DataFrame) -> DataFrame:
    """(scope, a, b): words of a scope within its number of edits (1 or 2) of each other, both ways, without equal ones; `tokens` has scope, token, edits.

    Grams are ordered by a table of counters of fixed size; any one order makes the prefix filter exact, and a gram that
    shares its counter only counts as more frequent than it is.
    """
    rows = cut(tokens.where(F.length("token") >= LEAST_LETTERS), "words")
    counts = np.zeros(COUNTERS, np.int64)
    for r in rows.select("token").mapInArrow(_count_grams, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        counts[r["slot"]] = r["n"]
    found = rows.mapInArrow(_prefix(counts), "scope string, token string, edits int, gram string, pos int")
    prefix = cut(found.select("scope", "token", "edits", F.xxhash64("scope", "gram").alias("k"), "pos"), "prefix")
    drop(rows)
    parts = min(PARTS, 1 + plan_bytes(prefix) // PART_BYTES)
    near = [settled(lambda i=i: _near_pairs(prefix.where(F.pmod("k", F.lit(parts)) == i)), "near") for i in range(parts)]
    return reduce(DataFrame.unionByName, near).distinct()


def _near_pairs(prefix: DataFrame) -> DataFrame:
    """The variants among words that share one of these grams."""
    # An edit moves the grams behind it by one place at most: places meet in stretches, each word in those its edits may reach.
    # Hashed keys: what a collision brings together, the distance parts.
    reach = F.array_distinct(F.array(*(F.floor((F.col("pos") + d * F.col("edits")) / STRETCH) for d in (-1, 1))))
    left = prefix.select("scope", "k", F.explode(reach).alias("at"), F.col("pos").alias("pa"), F.col("token").alias("a"), "edits")
    right = prefix.select("k", F.floor(F.col("pos") / STRETCH).alias("at"), F.col("pos").alias("pb"), F.col("token").alias("b"))
    shorter = F.least(F.length("a"), F.length("b"))
    # A swap is two of levenshtein's edits.
    two = (F.col("edits") == 2) & (shorter >= LONG_LETTERS)
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= F.when(two, 2).otherwise(1)) & F.when(two, F.levenshtein("a", "b", 4) >= 0).otherwise(F.levenshtein("a", "b", 2) >= 0)
    pairs = left.join(right, ["k", "at"]).where((F.abs(F.col("pa") - F.col("pb")) <= F.col("edits")) & close).select("scope", "a", "b", "edits").distinct()
    return pairs.mapInArrow(_near_words, "scope string, a string, b string")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec, bare, scope, place, keys): what a person is met by, among those of its place (near) or as a name alone.

    A word stands as itself, its commoner variants and the names it is short for, so that of two matching words one stands as
    the other or both as a third. What verification accepts has two words matched (kind 0), or one and
    - no other word on either side: an initial shared (0), or no initials on one of them (1 meets 2);
    - other words on one side only: the other side's initials cover them (1 meets 2);
    - other words on both sides: initials cover them crosswise, and the word is the heaviest of one side (1 meets 2).
    """
    for batch in batches:
        kinds, nears, texts, ends = [], [], [], [0]
        for words, inits, heavy, place, alts in zip(*(batch.column(c).to_pylist() for c in ("words", "inits", "heavy", "place", "alts")), strict=True):
            for near in (False, True) if place is not None else (False,):
                stands = {w: {w, *(f"={f}" for f in STANDS.get(w, ()))} for w in words}
                for x in alts or ():
                    if near or not x["near"]:
                        stands[x["token"]].add(x["as"])
                found = set()
                for i, w in enumerate(words):
                    for t in stands[w]:
                        found.update((0, "\x1f".join(sorted((t, u)))) for v in words[i + 1 :] for u in stands[v])
                        if len(words) == 1:
                            found.update((kind, f"{t}\x1f{c}\x1f{what}") for c in inits for kind, what in ((0, "single"), (2, "one")))
                            found.add((2, f"{t}\x1f\x1fnone"))
                            if not inits:
                                found.add((1, f"{t}\x1f\x1fnone"))
                            continue
                        rest = words[1] if i == 0 else words[0]
                        firsts = {rest[0], *(f[0] for f in STANDS.get(rest, ()))}
                        found.update((1, f"{t}\x1f{c}\x1fone") for c in firsts)
                        if inits:
                            found.update((2, f"{t}\x1f{c}\x1fboth") for c in inits)
                            if w in heavy:
                                found.update((1, f"{t}\x1f{c}\x1fboth") for c in firsts)
                for kind, text in found:
                    kinds.append(kind)
                    nears.append(near)
                    texts.append(text)
            ends.append(len(texts))
        keys = pa.StructArray.from_arrays([pa.array(kinds, pa.int32()), pa.array(nears, pa.bool_()), pa.array(texts, pa.string())], ["kind", "near", "text"])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rec", "bare", "scope", "place")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)], names=["rec", "bare", "scope", "place", "keys"])


class _Record:
    """A record as verification reads it, unpacked from its line."""

    __slots__ = ("forms", "inits", "place", "weights", "words")

    def __init__(self, line: str):
        words, inits, forms, place, tokens, weights = line.split("\x1e")
        self.words, self.inits, self.forms, self.place = words.split(" "), inits.split(), forms.split(), place
        self.weights = dict(zip(tokens.split(" "), map(float, weights.split(" ")), strict=True))


def _line() -> Column:
    """words, initials, forms, place, tokens and weights of a record in one string."""
    return F.concat_ws("\x1e", F.array_join("words", " "), F.array_join("inits", " "), F.array_join("forms", " "), F.coalesce("place", F.lit("")), F.array_join("ws.token", " "), F.array_join(F.transform("ws.weight", lambda w: w.cast("string")), " "))


def _placeless() -> Column:
    """The line of a record as that of its name alone."""
    part = F.split("line", "\x1e")
    return F.concat_ws("\x1e", part[0], part[1], part[2], F.lit(""), part[4], part[5])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, _Record] = {}

    def record(line: str) -> _Record:
        r = known.get(line)
        if r is None:
            if len(known) > 50_000:
                known.clear()
            r = known[line] = _Record(line)
        return r

    for batch in batches:
        keep = []
        for human, x, y in zip(*(batch.column(c).to_pylist() for c in ("human", "a", "b")), strict=True):
            a, b = record(x), record(y)
            if human:
                known_place = a.place != "" and a.place == b.place
                score = match_persons((a.words, a.inits), (b.words, b.inits), a.weights, b.weights, 2 if known_place else 1)
            else:
                score = match_things((a.words, a.inits, a.forms), (b.words, b.inits, b.forms), a.weights, b.weights)
            keep.append(score >= THETA)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["ra", "rb", "place"])


def linked(names: DataFrame) -> DataFrame:
    """(scope, id, grp): from rows (scope, human, id, name, where), the group of each id; ids without a usable name are left out."""
    with swept(names.sparkSession):
        return settled(lambda: _linked(names), "linked")


def _linked(names: DataFrame) -> DataFrame:
    """As `linked`; what is written is deleted as soon as nothing reads it any more, as the parts are larger than the input."""
    src = names.where(F.col("name").isNotNull() & F.col("id").isNotNull() & F.col("scope").isNotNull())
    spelt = src.select("scope", "human", "name", "where").distinct()
    parsed = cut(spelt.mapInArrow(_parse, "scope string, human boolean, name string, where string, rec binary, bare binary, words array<string>, inits array<string>, forms array<string>, place string"), "names")
    records = cut(parsed.groupBy("rec").agg(*(F.first(c).alias(c) for c in ("bare", "scope", "human", "words", "inits", "forms", "place"))), "records")
    ids = cut(_ids(src, parsed), "ids")
    drop(parsed)
    each = records.select("rec", "scope", F.explode(F.array_distinct("words")).alias("token"))
    tokens = cut(each.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df")), "tokens")
    # Forms without gaps are compared like words, so that a typo in one does not part it. Within one place the words
    # are few, so two edits are told from other words there, if these are long.
    wide = tokens.select("scope", "token").unionByName(records.select("scope", F.explode("forms").alias("token"))).distinct().withColumn("edits", F.lit(1))
    local = records.where(F.col("human") & F.col("place").isNotNull()).select(_at().alias("scope"), F.explode("words").alias("token")).where(F.length("token") >= LONG_LETTERS).distinct().withColumn("edits", F.lit(2))
    similar = settled(lambda: variants(wide.unionByName(local)), "variants")
    full = settled(lambda: _weighed(records, each, tokens, similar), "weighed")
    drop(records)
    pairs = settled(lambda: _candidates(full, tokens, similar), "pairs")
    drop(tokens, similar)
    lines = full.select("rec", "human", "place", "line").unionByName(full.where("human AND place IS NOT NULL").select(F.col("bare").alias("rec"), "human", F.lit(None).cast("string").alias("place"), _placeless().alias("line"))).dropDuplicates(["rec"])
    a, b = lines.select(F.col("rec").alias("ra"), "human", "place", F.col("line").alias("a")), lines.select(F.col("rec").alias("rb"), F.col("line").alias("b"))
    half = cut(pairs.join(a, "ra"), "half")
    drop(pairs)
    checked = half.join(b, "rb").select("ra", "rb", "place", "human", "a", "b")
    links = cut(checked.mapInArrow(_verify, "ra binary, rb binary, place string"), "links")
    drop(half)
    brief = cut(full.select("rec", "bare", "human", "place"), "brief")
    drop(full)
    return _groups(ids, brief, links)


def _at() -> Column:
    """The scope of a place's own words."""
    return F.concat_ws("\x1f", "scope", "place")


def _weighed(records: DataFrame, each: DataFrame, tokens: DataFrame, similar: DataFrame) -> DataFrame:
    """The records with their words by weight, their heaviest words, and their line for verification."""
    spark = records.sparkSession
    total = tokens.groupBy("scope").agg(F.sum("df").alias("N"))
    # Short forms count with the names they stand for; the list is fixed and small.
    kin = spark.createDataFrame(sorted({p for w, fulls in STANDS.items() for x in fulls if x != w for p in ((w, x), (x, w))}), "a string, b string")
    kin = tokens.select("scope", F.col("token").alias("a")).join(F.broadcast(kin), "a").select("scope", "a", "b")
    around = similar.unionByName(kin).distinct().join(tokens.select("scope", F.col("token").alias("b"), F.col("df").alias("dfb")), ["scope", "b"]).groupBy("scope", F.col("a").alias("token")).agg(F.sum("dfb").alias("more"))
    weight = F.log(1 + F.col("N") / (F.col("df") + F.coalesce("more", F.lit(0))))
    weights = tokens.join(around, ["scope", "token"], "left").join(total, "scope").select("scope", "token", weight.alias("weight"))
    words = cut(each.join(weights, ["scope", "token"]).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("weight", "token")), False).alias("ws")), "weights")
    heavy = F.transform(F.filter("ws", lambda x: x["weight"] >= F.col("ws")[0]["weight"]), lambda x: x["token"])
    return records.join(words, "rec").select("rec", "bare", "scope", "human", "place", "words", "inits", F.array_union(heavy, F.col("forms")).alias("heavy"), F.array_union(F.col("ws.token"), F.col("forms")).alias("keys"), _line().alias("line"))


def _candidates(full: DataFrame, tokens: DataFrame, similar: DataFrame) -> DataFrame:
    """(ra, rb): pairs of records that verification may accept, each once: of one place, or of names without their places.

    Keys are hashed, as verification settles what a collision brings together.
    A record of unknown place meets names, not records, so that a name that many places have is compared once.
    """
    other = similar.select(F.col("scope").alias("at"), F.col("a").alias("token"), F.col("b").alias("as"))
    # Any one order of words will do; by frequency few words stand as many others.
    often = tokens.groupBy("token").agg(F.sum("df").alias("n"))
    common = other.join(often, "token").withColumnRenamed("n", "_n").join(often.withColumnRenamed("token", "as"), "as").where(F.struct("n", "as") > F.struct(F.col("_n").alias("n"), F.col("token").alias("as"))).select("at", "token", "as")
    people = full.where("human").select("rec", "bare", "scope", "place", "words", "inits", "heavy")
    words = people.select("rec", "scope", F.when(F.col("place").isNotNull(), _at()).alias("near"), F.explode(F.array_distinct("words")).alias("token"))
    spots = words.select("rec", "token", F.explode(F.array(F.struct(F.col("scope").alias("at"), F.lit(False).alias("near")), F.struct(F.col("near").alias("at"), F.lit(True).alias("near")))).alias("x")).select("rec", "token", "x.at", "x.near")
    alts = spots.where("at IS NOT NULL").join(common, ["at", "token"]).groupBy("rec").agg(F.collect_set(F.struct("token", "as", "near")).alias("alts"))
    written = cut(people.join(alts, "rec", "left").mapInArrow(_keys, "rec binary, bare binary, scope string, place string, keys array<struct<kind:int,near:boolean,text:string>>"), "keys")
    keys = written.select("rec", "bare", "scope", "place", F.explode("keys").alias("x")).select("rec", "bare", "scope", "place", "x.kind", "x.near", "x.text")
    meet = lambda kind, *place: F.xxhash64("scope", "text", kind, *place)
    turned = F.when(F.col("kind") == 0, 0).otherwise(3 - F.col("kind"))
    # Persons meet in one place, or as names if one's place is unknown.
    near, far = keys.where("near"), keys.where("NOT near")
    in_place = _met(near.where("kind < 2").select("rec", meet(F.col("kind"), "place").alias("k")), near.where("kind <> 1").select("rec", meet(turned, "place").alias("k")))
    as_names = _met(far.where("place IS NULL").select("rec", meet(F.col("kind")).alias("k")), far.select(F.col("bare").alias("rec"), meet(turned).alias("k")).distinct())
    things = full.where("NOT human")
    heads = things.select("rec", "scope", F.explode("heavy").alias("token"))
    heads = heads.unionByName(heads.join(other.withColumnRenamed("at", "scope"), ["scope", "token"]).select("rec", "scope", F.col("as").alias("token")))
    of_things = _met(heads.select("rec", F.xxhash64("scope", "token").alias("k")), things.select("rec", "scope", F.explode("keys").alias("token")).select("rec", F.xxhash64("scope", "token").alias("k")))
    # No pair is in two of them; one after the other they take less disk.
    in_place, as_names = cut(in_place, "met"), cut(as_names, "met")
    drop(written)
    return in_place.unionByName(as_names).unionByName(cut(of_things, "met"))


def _met(asking: DataFrame, answering: DataFrame) -> DataFrame:
    """(ra, rb): the records with one k, each pair once."""
    met = asking.select("k", F.col("rec").alias("ra")).join(answering.select("k", F.col("rec").alias("rb")), "k").where("ra <> rb")
    return met.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).distinct()


def _ids(src: DataFrame, parsed: DataFrame) -> DataFrame:
    """(scope, id, rec): the records of each id."""
    spelt = src.select("scope", "id", "name", "where").distinct()
    # A null place joins as the empty one, which no place is parsed from either.
    by = ["scope", "name", "_where"]
    return spelt.withColumn("_where", F.coalesce("where", F.lit(""))).join(parsed.select("scope", "name", F.coalesce("where", F.lit("")).alias("_where"), "rec"), by).select("scope", "id", "rec").distinct()


def _groups(ids: DataFrame, full: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, id, grp) from the links between records."""
    # Things have no place: for them every record is of unknown place and all links hold.
    firm = links.where("place IS NOT NULL").select("ra", "rb")
    loose = links.where("place IS NULL").select("ra", "rb")
    unplaced = full.where("place IS NULL").select("rec")
    # What each record of unknown place matches: names, its own included where places have it.
    both = loose.unionByName(loose.select(F.col("rb").alias("ra"), F.col("ra").alias("rb"))).unionByName(unplaced.select(F.col("rec").alias("ra"), F.col("rec").alias("rb")))
    asked = cut(both.join(unplaced.withColumnRenamed("rec", "ra"), "ra", "left_semi"), "asked")
    placed = full.where("human AND place IS NOT NULL").select("rec", "bare")
    torn = cut(asked.join(placed.select(F.col("bare").alias("rb")).distinct(), "rb", "left_semi").select(F.col("ra").alias("open"), "rb"), "torn")
    # Records of unknown place that match no place are linked among themselves.
    free = cut(unplaced.join(torn.select(F.col("open").alias("rec")), "rec", "left_anti"), "free")
    among = asked.join(free.withColumnRenamed("rec", "ra"), "ra", "left_semi").join(free.withColumnRenamed("rec", "rb"), "rb", "left_semi").select("ra", "rb")
    single = placed.select(F.col("rec").alias("ra"), F.col("rec").alias("rb"))
    groups = settled(lambda: components(firm.unionByName(among).unionByName(single)), "groups")
    drop(links, asked, free)
    # Of a name, the first and the last of the groups that its places give it; one group only is no doubt.
    held = placed.join(groups.withColumnRenamed("node", "rec"), "rec").groupBy(F.col("bare").alias("rb")).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    attach = torn.join(held, "rb").groupBy("open").agg(F.min("low").alias("grp"), F.max("high").alias("other"))
    one = attach.where(F.col("grp") == F.col("other")).select(F.col("open").alias("rec"), "grp")
    alone = attach.where(F.col("grp") != F.col("other")).select(F.col("open").alias("rec"), F.col("open").alias("grp"))
    of_record = groups.select(F.col("node").alias("rec"), F.col("component").alias("grp")).unionByName(one).unionByName(alone)
    return ids.join(of_record, "rec").select("scope", "id", "grp").distinct()


def pairs_of(groups: DataFrame) -> DataFrame:
    """(scope, id_a, id_b): all pairs of different ids of a group, each once."""
    a, b = groups.select("scope", "grp", F.col("id").alias("id_a")), groups.select("scope", "grp", F.col("id").alias("id_b"))
    return a.join(b, ["scope", "grp"]).where("id_a < id_b").select("scope", "id_a", "id_b").distinct()
