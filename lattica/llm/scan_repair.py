"""Repair of text from scanned pages: furniture, words broken at line ends, misread characters.

Three averaged perceptrons, trained here on pages made from a bounded sample of the corpus's own clean text:

* a character editor that rewrites a word by keep, replace, delete and insert operations. Its inventory of
  operations is what aligning noisy with clean training words showed; its features are the operations,
  their neighbours, and how common the word is before and after the edit;
* a line joiner that decides at a line end between dropping the hyphen (a broken word), keeping it (a
  compound) and a plain space;
* a line labeller that finds running headers and page numbers from their build and their place on the page
  (distance from a page break or page number, an interrupted sentence around them).

How common a word is comes from one count over all texts, of which only unwrapped ones (whose lines do not end
at a page's width) count as clean. Words and breaks are decided once per distinct form: the forms of wrapped
texts, joined with the counts of what they might have been. Rows are then joined with these decisions, at every
size in one way: a bit table of bounded size over the decided forms is broadcast, the words it may know leave
their rows, and an exact join keeps the decided ones.

Defined cases: null, empty and blank texts have no noise and are returned as they are. Texts without noise keep
their words; wrapped ones are returned as paragraphs. The first and last word of a chunk may be cut by its
window: they are judged only where they hold a digit, which no cut puts there. Very long texts are read whole. Repeated rows are marked alike. Extra columns are
ignored. On an empty corpus nothing is learned and nothing is changed.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import cut

#: At most so many clean texts train the models.
SAMPLE_TEXTS = 300
SAMPLE_WORDS = 6000
EPOCHS = 4
#: Above this frequency per million a form is a word, whatever it resembles.
COMMON_PPM = 20.0
#: What a form is corrected to has been seen so often in clean text, at least, and so often per million words.
LEAST_SEEN = 5
LEAST_PPM = 5.0
#: Bits of the table of decided forms: so many per form, within these bounds (a power of two each, 8 MB at most).
BITS_PER_FORM, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 26
#: Kinds of rows that a window has cut out of a longer text.
WINDOWED = ("chunk",)

TOKEN = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"(?<![^\W_])[^\W_]+(?:[-‐][^\W_]+)+")
BREAK = re.compile(r"([^\W\d_]+)([-‐¬\xad]+)([ \t]*)\r?\n[ \t]*([^\W\d_]+)")
#: A hyphen at a line end: what a broken word must have.
HYPHEN_END = re.compile(r"[-‐¬\xad][ \t]*\r?\n")
#: Usual confusions of optical character recognition, clean to misread.
CONFUSIONS = [("o", "0"), ("O", "0"), ("l", "1"), ("I", "1"), ("i", "l"), ("l", "i"), ("I", "l"), ("s", "5"), ("S", "5"), ("B", "8"), ("g", "9"), ("z", "2"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("in", "m"), ("m", "in"), ("d", "cl"), ("cl", "d"), ("g", "q"), ("q", "g"), ("a", "ä"), ("a", "á"), ("o", "ö"), ("u", "ü"), ("w", "vv"), ("vv", "w"), ("h", "li"), ("li", "h"), ("n", "ri"), ("t", "f"), ("f", "t"), ("v", "y"), ("y", "v")]


def tokens_of(text: str) -> list[str]:
    """Words in lower case, without those broken at a line end."""
    return TOKEN.findall((BREAK.sub(" ", text) if HYPHEN_END.search(text) else text).lower())


class Perceptron:
    """Averaged weights over string features; picks the highest-scoring of a list of candidates."""

    def __init__(self):
        self.w: dict[str, float] = defaultdict(float)
        self.sums: dict[str, float] = defaultdict(float)
        self.t = 0

    def learn(self, options: list[list[str]], gold: int) -> None:
        self.t += 1
        guess = max(range(len(options)), key=lambda i: (sum(self.w[f] for f in options[i]), -i))
        if guess != gold:
            for f in options[gold]:
                self.w[f] += 1
                self.sums[f] += self.t
            for f in options[guess]:
                self.w[f] -= 1
                self.sums[f] -= self.t

    def averaged(self) -> dict[str, float]:
        return {f: v for f, x in self.w.items() if (v := x - self.sums[f] / max(1, self.t))}


def pick(w: dict[str, float], options: list[list[str]]) -> int:
    return max(range(len(options)), key=lambda i: (sum(w.get(f, 0.0) for f in options[i]), -i))


def bucket(n: float, total: float) -> str:
    """How common a form is, per million words of clean text."""
    if n <= 0:
        return "0"
    ppm = n * 1e6 / max(total, 1.0)
    for top, name in ((0.2, "a"), (1, "b"), (5, "c"), (20, "d"), (100, "e"), (1000, "f")):
        if ppm < top:
            return name
    return "g"


# Characters


def rules_of(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """From (noisy, clean) words, what each misread piece stood for: the differing middle of each pair."""
    seen: Counter = Counter()
    for noisy, clean in pairs:
        a, b = noisy, clean
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        a, b = a[k:], b[k:]
        k = 0
        while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
            k += 1
        a, b = a[: len(a) - k], b[: len(b) - k]
        if not a or not b:  # an insertion or deletion takes its left neighbour along
            at = noisy.find(a) if a else 0
            at = len(noisy) - len(a) - k
            left = noisy[at - 1 : at]
            a, b = left + a, left + b
        if 0 < len(a) <= 2 and 0 < len(b) <= 2:
            seen[a, b] += 1
    out: dict[str, list[str]] = {}
    for (a, b), n in seen.items():
        if n >= 2:
            out.setdefault(a, []).append(b)
    return out


def operations(a: str, b: str) -> list[str]:
    """The character operations that turn a misread piece into what it stood for."""
    ops = [f"replace {x}>{y}" if x != y else f"keep {x}" for x, y in zip(a, b, strict=False)]
    ops += [f"delete {x}" for x in a[len(b) :]] + [f"insert {y}" for y in b[len(a) :]]
    return ops


def kind_of(c: str) -> str:
    return "^" if not c else "9" if c.isdigit() else "a" if c.isascii() else "u"


def edits(word: str, rules: dict[str, list[str]]) -> Iterator[tuple[str, list[str]]]:
    """(edited word, features of its operations), one or two pieces rewritten."""
    single = []
    for i in range(len(word)):
        for n in (1, 2):
            for b in rules.get(word[i : i + n], ()) if i + n <= len(word) else ():
                ops = operations(word[i : i + n], b)
                around = kind_of(word[i - 1 : i]) + kind_of(word[i + n : i + n + 1])
                single.append((i, n, b, [*ops, *(f"{o}|{around}" for o in ops)]))
    for i, n, b, f in single:
        yield word[:i] + b + word[i + n :], f
    if len(word) >= 6:
        for x, (i, n, b, f) in enumerate(single):
            for j, m, c, g in single[x + 1 :]:
                if j >= i + n:
                    yield word[:i] + b + word[i + n : j] + c + word[j + m :], [*f, *g, "two"]


def shape(word: str) -> str:
    return ("9" if any(c.isdigit() for c in word) else "") + ("u" if not word.isascii() else "") + str(min(len(word), 9) // 3)


def keep_features(word: str, n: float, total: float) -> list[str]:
    return ["keep", f"keep seen {bucket(n, total)}", f"keep shape {shape(word)}"]


def edit_features(word: str, n: float, m: float, total: float, ops: list[str]) -> list[str]:
    return [*ops, f"edit seen {bucket(n, total)}>{bucket(m, total)}", f"edit to {bucket(m, total)}", f"edit shape {shape(word)}"]


# Line ends


def break_features(left: str, mark: str, right: str, seen: Callable[[str], float], total: float) -> list[list[str]]:
    """Features of (join, compound) at a line end."""
    b = lambda s: bucket(seen(s), total)
    base = [f"whole {b(left + right)}", f"compound {b(left + '-' + right)}", f"left {b(left)}", f"right {b(right)}", f"both {b(left)}{b(right)}", f"mark {mark}", f"odds {b(left + right)}{b(left + '-' + right)}"]
    return [["join " + f for f in base], ["split " + f for f in base]]


def mark_of(hyphen: str, space: str) -> str:
    return "soft" if "\xad" in hyphen or "¬" in hyphen else "spaced" if space else "plain"


# Lines

NUMBER = re.compile(r"\W*(?:(?:p|pp|pg|page|seite|s|pág|página|第)\b\.?)?\W*\d{1,4}(?:\s*(?:of|/|von|de)\s*\d{1,4})?\W*(?:页)?\W*", re.I)
GAP = re.compile(r"\S[ \t]{3,}\S")
EDGE_NUMBER = re.compile(r"^\d{1,4}\s{2,}\S|\S\s{2,}\d{1,4}$")
CITED = re.compile(r"\bvol\b\.?\s*\d+|\bno\b\.?\s*\d+|,\s*pp?\.\s*\d+\s*$", re.I)
ET_AL = re.compile(r"^\W*[^\W\d_][\w'’-]+(?:\s+(?:and|&)\s+[^\W\d_][\w'’-]+|\s+et al\.?)\W*$")
ENDS = re.compile(r"[.!?:。！？”\")]\s*$")


def lines_of(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, line, whether a page break precedes it)."""
    out, at, page = [], 0, False
    for m in re.finditer(r"\r?\n|\f", text):
        out.append((at, m.start(), text[at : m.start()], page))
        at, page = m.end(), m.group() == "\f"
    out.append((at, len(text), text[at:], page))
    return out


def wrapped(text: str) -> bool:
    """Whether lines end at a page's width: two or more full lines followed by another within a paragraph."""
    lines = text.split("\n")
    if len(lines) < 2:
        return False
    full = [len(a) for a, b in zip(lines, lines[1:], strict=False) if a.strip() and b.strip() and 30 <= len(a) <= 110]
    longest = max(map(len, lines))
    return len(full) >= 2 and longest <= 130 or len(full) == 1 and longest <= 110 and "-\n" in text


def page_of(lines: list) -> tuple[int, bool]:
    """(width, raggedness): the longest line, and whether lines within paragraphs often end far from it."""
    width = max(len(x[2]) for x in lines)
    inner = [len(a[2].rstrip()) for a, b in zip(lines, lines[1:], strict=False) if a[2].strip() and b[2].strip() and len(a[2]) > 20]
    return width, len(inner) < 2 or sum(n > 0.75 * width for n in inner) < 0.6 * len(inner)


#: What furniture other than a number or a line at a page break shows.
SIGNS = re.compile(r"\S[ \t]{3,}\S|^\d{1,4}\s{2,}\S|\S\s{2,}\d{1,4}$|\bvol\b|\bno\b|pp?\. *\d|et al|^\W*[^\W\d_][\w'’-]+\s+(?:and|&)\s+[^\W\d_][\w'’-]+\W*$", re.I)


class Page:
    """The lines of a text with what their features share, worked out once."""

    def __init__(self, text: str):
        self.lines = lines_of(text)
        self.bare = [x[2].strip() for x in self.lines]
        self.number = [bool(s) and len(s) < 24 and any(c.isdigit() for c in s) and bool(NUMBER.fullmatch(s)) for s in self.bare]
        self.shape = None

    def neighbour(self, k: int, step: int) -> int:
        k += step
        while 0 <= k < len(self.bare) and not self.bare[k]:
            k += step
        return k if 0 <= k < len(self.bare) else -1


def line_features(page: Page, k: int) -> list[str] | None:
    """Features of line k being furniture; None if it plainly is not."""
    lines, line = page.lines, page.bare[k]
    if not line or len(line) > 100:
        return None
    number = page.number[k]
    i, j = page.neighbour(k, -1), page.neighbour(k, 1)
    before, after = page.bare[i] if i >= 0 else "", page.bare[j] if j >= 0 else ""
    breaks = lines[k][3] or k + 1 < len(lines) and lines[k + 1][3]
    top = lines[k][3] or k >= 1 and not page.bare[k - 1] and lines[k - 1][3]
    by_number = i >= 0 and page.number[i] and len(before) < 20 or j >= 0 and page.number[j] and len(after) < 20
    if not (number or breaks or top or by_number or SIGNS.search(line)):
        return None
    cuts = bool(before) and not ENDS.search(before) and bool(after) and (after[0].islower() or before[-1] in "-‐¬\xad")
    letters = [c for c in line if c.isalpha()]
    if page.shape is None:
        page.shape = page_of(lines)
    width, ragged = page.shape
    f = {
        "number": number, "break": breaks, "top": top, "bynumber": by_number, "gap": bool(GAP.search(line)), "edge": bool(EDGE_NUMBER.search(line)), "cited": bool(CITED.search(line)), "etal": bool(ET_AL.match(line)),
        "cuts": cuts, "caps": len(letters) > 5 and sum(c.isupper() for c in letters) > 0.8 * len(letters), "ends": bool(ENDS.search(line)), "lower": line[0].islower(), "title": sum(w[0].isupper() for w in line.split()) > 0.6 * len(line.split()),
        "full": len(line) > 0.8 * width, "bare": line.isdigit(), "dash": line[0] in "-–—" and number, "words": len(line.split()) > 8, "tab": "\t" in lines[k][2], "first": not before, "last": not after, "wide": width > 130, "ragged": ragged, "afull": len(before) > 0.75 * width, "spaces": lines[k][2] != lines[k][2].strip(), "alone": k > 0 and not lines[k - 1][2].strip(),
        "numbered": bool(re.match(r"\d+(\.\d+)*\.\s", line)), "oneword": len(line.split()) == 1 and not number,
    }
    on = [x for x, v in f.items() if v]
    return ["bias", *on, *(f"{a}&{b}" for i, a in enumerate(on) for b in on[i + 1 :])]


def furniture(text: str, w: dict[str, float]) -> list[tuple[int, int]]:
    """(start, end) of the lines that are running headers or page numbers."""
    if "\n" not in text and "\f" not in text:
        return []
    page = Page(text)
    return [(x[0], x[1]) for k, x in enumerate(page.lines) if (f := line_features(page, k)) and sum(w.get(a, 0.0) for a in f) > 0]


# Training


def noisy_word(word: str, rng: random.Random) -> str | None:
    options = [(m.start(), a, b) for a, b in CONFUSIONS for m in re.finditer(re.escape(a), word)]
    if not options:
        return None
    i, a, b = rng.choice(options)
    return word[:i] + b + word[i + len(a) :]


def train(texts: list[str], counts: dict[str, float], total: float, seed: int = 11) -> dict:
    """The three models from clean texts and the counts of their words and of what these resemble."""
    rng = random.Random(seed)
    if not texts:
        return {"rules": {}, "chars": {}, "breaks": {}, "lines": {}}
    bag = Counter(w for t in texts for w in TOKEN.findall(t.lower()) if len(w) >= 3 and not w.isdigit())
    words = [w for w, _ in sorted(bag.items(), key=lambda x: (-x[1], x[0]))][:SAMPLE_WORDS]
    pairs = [(x, w) for w in words for _ in range(3) if (x := noisy_word(w, rng))]
    rules = rules_of([(x.lower(), w) for x, w in pairs])
    seen = lambda s: counts.get(s, 0.0)
    chars = Perceptron()
    examples = [(x.lower(), w) for x, w in pairs] + [(w, w) for w in words for _ in range(2)]
    # Unseen names are kept: words of the sample, judged as if never counted.
    hidden = [w for w in words if bag[w] <= 3]
    for _ in range(EPOCHS):
        rng.shuffle(examples)
        for x, w in examples[: 4 * SAMPLE_WORDS]:
            n = 0.0 if x != w else seen(w) if rng.random() < 0.8 or w not in hidden else 0.0
            options, gold = [keep_features(x, n, total)], 0 if x == w else -1
            for y, ops in edits(x, rules):
                if seen(y) >= max(LEAST_SEEN, LEAST_PPM * total / 1e6) or y == w and x != w:
                    if y == w and gold < 0:
                        gold = len(options)
                    options.append(edit_features(x, n, seen(y), total, ops))
            if gold >= 0 and len(options) > 1:
                chars.learn(options, gold)
    breaks = Perceptron()
    running = [w for t in texts for w in TOKEN.findall(t.lower()) if len(w) >= 4 and w.isalpha()]
    compounds = [c for t in texts for m in COMPOUND.findall(t.lower()) for c in [m.split("-")] if len(c) >= 2]
    cases = []
    for w in running[: 3 * SAMPLE_WORDS]:
        k = rng.randint(2, len(w) - 2)
        cases.append((w[:k], w[k:], 0))
    for c in compounds[:SAMPLE_WORDS]:
        k = rng.randint(1, len(c) - 1)
        cases.append((c[k - 1], c[k], 1))
    for _ in range(EPOCHS):
        rng.shuffle(cases)
        for a, b, gold in cases:
            mark = rng.choice(["plain", "soft", "spaced"]) if gold == 0 else "plain"
            hide = gold == 0 and rng.random() < 0.15  # a name that clean text does not have
            breaks.learn(break_features(a, mark, b, (lambda s, x=a + b, h=hide: 0.0 if h and s == x else seen(s)), total), gold)
    lines = Perceptron()
    for _ in range(EPOCHS):
        for t in texts:
            page, labels = made_page(t, texts, rng)
            rows = Page(page)
            for k, _ in enumerate(rows.lines):
                f = line_features(rows, k)
                if f:
                    lines.learn([[], f], int(labels[k]))
    return {"rules": rules, "chars": chars.averaged(), "breaks": breaks.averaged(), "lines": lines.averaged()}


def made_page(text: str, texts: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A wrapped text with furniture at page ends (or none), and which of its lines are furniture."""
    width, rows = rng.randint(50, 72), []
    for para in text.split("\n"):
        line = ""
        for w in para.split():
            if line and len(line) + 1 + len(w) > width:
                rows.append(line)
                line = w
            else:
                line = f"{line} {w}" if line else w
        rows.append(line)
    heads = ["Conclusion", "EXPERIMENTS", "SECTION", "2. Limitations", "3. RELATED WORK", "1.2. Setup", "Abstract", "References"]
    for _ in range(rng.randint(0, 2)):
        at = rng.randint(0, len(rows))
        rows[at:at] = ["", rng.choice(heads)] if rng.random() < 0.7 else [rng.choice(heads)]
    out, labels = [], []
    odd = rng.random()
    if odd < 0.25:
        # Not a scan: line ends and other spaces put anywhere.
        p = rng.choice([0.03, 0.08, 0.15])
        page = re.sub(r"\s+", lambda m: rng.choice(["\n", " \n", "\r\n", "\n "]) if rng.random() < p else rng.choice([" ", " ", "  "]), text)
        return page, [False] * len(lines_of(page))
    if odd < 0.5:
        # Not a scan: tables, lists and headings that resemble furniture.
        extra = rng.choice([["Model   Split  Score", f"Alpha-b2   test   {rng.randint(10, 99)}.4", f"Alpha-c9   dev   {rng.randint(10, 99)}.8"], [f"{rng.randint(1, 9)} ", "more of it"], ["Name\tDev\tTest", f"Alpha\t{rng.randint(10, 99)}.{rng.randint(0, 9)}\t{rng.randint(10, 99)}"], [f"{rng.randint(1, 9)}. Discussion"], [f"[{rng.randint(1, 9)}] Some, A. (2001). Title. Journal, 3(2), 10-20."], ["Key: value", "Other: 12"], [f"{rng.randint(1, 4)}.{rng.randint(1, 9)}. Results"], [f"({rng.randint(1, 9)})."]])
        at = rng.randint(0, len(rows))
        rows[at:at] = extra
        return "\n".join(rows), [False] * len(rows)
    title = " ".join(rng.choice(texts).split()[: rng.randint(4, 7)])
    name = next((w for w in rng.choice(texts).split() if w[:1].isupper() and len(w) > 4), "Author").strip(".,")
    n, step = rng.randint(1, 400), rng.randint(6, 30)
    head_style, foot_style, feed = rng.randint(0, 7), rng.randint(0, 6), rng.random() < 0.6
    for i, row in enumerate(rows):
        if i and i % step == 0:
            feet = [[str(n)], [f"- {n} -"], [f"— {n} —"], [f"p. {n}"], [f"Page {n} of {n + 40}"], [], [f"Journal of {name} Studies, Vol. {n % 9}, p. {n}"]][foot_style]
            cut_title = title[: rng.randint(20, 48)]
            heads = [[cut_title.upper()], [f"{cut_title}    {name}"], [f"{n}    {cut_title.upper()}"], [f"Journal of {name}    {n}"], [f"{name} et al."], [cut_title], [], [f"Proceedings of the {name} Meeting"]][head_style]
            if not feet and not heads:
                feet = [str(n)]
            for x in feet:
                out.append(x)
                labels.append(True)
            if feed:
                out.append("\f")
                labels.append(False)
            for x in heads:
                out.append(x)
                labels.append(True)
            n += 1
        out.append(row)
        labels.append(False)
    page, kept = "", []
    for k, (x, y) in enumerate(zip(out, labels, strict=True)):
        if x == "\f":
            page += "\f"
            continue
        page += x + ("\n" if k + 1 < len(out) and (out[k + 1] != "\f" or rng.random() < 0.5) else "")
        kept.append(y)
    rows2 = lines_of(page)
    if len(rows2) != len(kept):  # a break after a line end makes an empty line
        it, fixed = iter(kept), []
        for r in rows2:
            fixed.append(next(it, False) if r[2] or len(rows2) - len(fixed) <= 1 else False)
        want = iter([y for x, y in zip(out, labels, strict=True) if x != "\f" and x != ""])
        fixed = [next(want, False) if r[2] != "" else False for r in rows2]
        kept = fixed
    return page, kept


# Passes over the corpus


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, clean, paged): words and compound pairs of each batch, counted by whether the text is wrapped."""
    for batch in batches:
        clean: Counter = Counter()
        paged: Counter = Counter()
        for text in batch.column("text").to_pylist():
            low = text.lower()
            if wrapped(text) or "\f" in text:
                paged.update(tokens_of(text))
            else:
                clean.update(TOKEN.findall(low))
                if "-" in low:
                    for c in COMPOUND.findall(low):
                        parts = c.split("-")
                        clean.update(f"{a}-{b}" for a, b in zip(parts, parts[1:], strict=False))
        forms = list(clean.keys() | paged.keys())
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([clean[f] for f in forms], pa.int64()), pa.array([paged[f] for f in forms], pa.int64())], names=["form", "clean", "paged"])


def counted(rows: DataFrame) -> DataFrame:
    """(form, clean, paged) over all texts; written once."""
    part = rows.select("text").mapInArrow(_count, "form string, clean bigint, paged bigint")
    return cut(part.groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("paged").alias("paged")), "forms")


def _candidates(rules: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, clean, keys = [], [], []
            for form, n in zip(batch.column("form").to_pylist(), batch.column("clean").to_pylist(), strict=True):
                for y in {y for y, _ in edits(form, rules)} - {form}:
                    items.append(form)
                    clean.append(n)
                    keys.append(y)
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(clean, pa.int64()), pa.array(keys, pa.string())], names=["item", "own", "key"])

    return run


def _decide_words(models: dict, total: float):
    rules, w = models["rules"], models["chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, fixed = [], []
            for x in batch.to_pylist():
                seen = {s["key"]: s["n"] for s in x["seen"]}
                options, words = [keep_features(x["item"], x["own"], total)], [x["item"]]
                for y, ops in edits(x["item"], rules):
                    if y in seen:
                        options.append(edit_features(x["item"], x["own"], seen[y], total, ops))
                        words.append(y)
                best = words[pick(w, options)]
                if best != x["item"]:
                    forms.append(x["item"])
                    fixed.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(fixed, pa.string())], names=["form", "fixed"])

    return run


def corrections(counts: DataFrame, total: float, models: dict) -> DataFrame:
    """(form, fixed): the misread forms of wrapped texts and what they stood for."""
    rare = counts.where((F.col("paged") > 0) & (F.col("clean") * 1e6 < COMMON_PPM * total) & (F.length("form") >= 3) & F.col("form").rlike(r"\p{L}.*\p{L}") & ~F.contains("form", F.lit("-")))
    asked = rare.select("form", "clean").mapInArrow(_candidates(models["rules"]), "item string, own bigint, key string")
    known = counts.where(F.col("clean") >= max(LEAST_SEEN, LEAST_PPM * total / 1e6)).select(F.col("form").alias("key"), F.col("clean").alias("n"))
    seen = asked.join(known, "key").groupBy("item", "own").agg(F.collect_list(F.struct("key", "n")).alias("seen"))
    return seen.mapInArrow(_decide_words(models, total), "form string, fixed string")


def _layout(lines: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, pages, found = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                spans = furniture(text, lines)
                breaks = [(m[1].lower(), mark_of(m[2], m[3]), m[4].lower()) for m in BREAK.finditer(text)] if HYPHEN_END.search(text) else []
                if spans or breaks:
                    keep.append(k)
                    pages.append(len(spans))
                    found.append([{"l": a, "m": m, "r": b} for a, m, b in breaks])
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("kind"), part.column("id"), pa.array(pages, pa.int32()), pa.array(found, pa.list_(pa.struct([("l", pa.string()), ("m", pa.string()), ("r", pa.string())])))], names=["kind", "id", "pages", "breaks"])

    return run


def _decide_breaks(models: dict, total: float):
    w = models["breaks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            join = []
            for x in batch.to_pylist():
                seen = {s["key"]: s["n"] for s in x["seen"] or () if s["key"] is not None}
                join.append(pick(w, break_features(x["l"], x["m"], x["r"], lambda s, d=seen: d.get(s, 0), total)) == 0)
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("m"), batch.column("r"), pa.array(join, pa.bool_())], names=["l", "m", "r", "join"])

    return run


def joins(layout: DataFrame, counts: DataFrame, total: float, models: dict) -> DataFrame:
    """(l, m, r, join): every distinct line end with a hyphen, and whether the word was broken there."""
    ends = layout.select(F.explode("breaks").alias("b")).select("b.*").distinct()
    asked = ends.select("l", "m", "r", F.explode(F.array("l", "r", F.concat("l", "r"), F.concat_ws("-", "l", "r"))).alias("key"))
    known = counts.where("clean > 0").select("form", F.col("clean").alias("n"))
    seen = asked.join(known, asked["key"] == known["form"], "left").groupBy("l", "m", "r").agg(F.collect_list(F.struct(F.col("form").alias("key"), "n")).alias("seen"))
    return seen.mapInArrow(_decide_breaks(models, total), "l string, m string, r string, join boolean")


def bit_table(forms: DataFrame) -> np.ndarray:
    """64-bit words of a table in which the place of every form's CRC-32 is set; its size is bounded whatever the number of forms."""
    n = forms.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_FORM * n):
        bits *= 2
    at = F.crc32(F.encode("form", "utf-8")).bitwiseAND(F.lit(bits - 1))
    words = forms.select(at.alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
    set_words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[set_words.column("word").to_numpy()] = set_words.column("bits").to_numpy().view(np.uint64)
    return table


def judged(text: str, windowed: bool, joined: bool = False) -> set[str]:
    """The words of a text that can be misread ones; with `joined` also what words broken at line ends were."""
    words = tokens_of(text)
    if windowed:
        words = [*words[1:-1], *(w for w in (*words[:1], *words[-1:]) if any(map(str.isdigit, w)))]
    if joined and HYPHEN_END.search(text):
        words += [(m[1] + m[4]).lower() for m in BREAK.finditer(text)]
    return set(words)


def _suspects(shipped, joined: bool):
    """(kind, id, form): the judged words that the bit table may know, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        mask, last = len(table) * 64 - 1, {}
        bits = table.tobytes()
        for batch in batches:
            at, forms = [], []
            for k, (kind, text) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                for w in judged(text, kind in WINDOWED, joined):
                    known = last.get(w)
                    if known is None:
                        if len(last) > 200_000:
                            last.clear()
                        place = crc32(w.encode("utf-8", "surrogatepass")) & mask
                        known = last[w] = bool(bits[place >> 3] >> (place & 7) & 1)
                    if known:
                        at.append(k)
                        forms.append(w)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("kind"), part.column("id"), pa.array(forms, pa.string())], names=["kind", "id", "form"])

    return run


def _repaired(lines: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, words, kept in zip(*(batch.column(c).to_pylist() for c in ("text", "words", "kept")), strict=True):
                texts.append(repair_text(text, {w["form"]: w["fixed"] for w in words or ()}, {(b["l"], b["m"], b["r"]) for b in kept or ()}, lines))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id"), pa.array(texts, pa.string())], names=["kind", "id", "text"])

    return run


class Repair:
    """The models and decisions over one corpus of rows (kind, id, text)."""

    def __init__(self, rows: DataFrame, seed: int = 11):
        self.rows = rows.where(F.col("text").isNotNull())
        self.counts = counted(self.rows)
        self.total = float(self.counts.agg(F.sum("clean")).first()[0] or 0)
        self.models = self._train(seed)
        self.words = cut(corrections(self.counts, self.total, self.models), "words")
        self.layout = cut(self.rows.mapInArrow(_layout(self.models["lines"]), f"kind string, id bigint, pages int, {'breaks array<struct<l:string,m:string,r:string>>'}"), "layout")
        self.ends = cut(joins(self.layout, self.counts, self.total, self.models), "ends")

    def _train(self, seed: int) -> dict:
        long = self.rows.where((F.length("text") > 400) & ~F.contains("text", F.lit("\f")))
        n = long.count()
        # By a hash of the key, so that only about the sample's texts travel, whatever the corpus.
        share = min(1_000_000, int(4 * SAMPLE_TEXTS * 1_000_000 / max(n, 1)) + 1)
        drawn = long.where(F.pmod(F.xxhash64("kind", "id"), F.lit(1_000_000)) < share)
        sample = [r.text for r in drawn.select("text", F.xxhash64("kind", "id").alias("h")).orderBy("h", "text").limit(4 * SAMPLE_TEXTS).collect()]
        texts = [t for t in sample if not wrapped(t)][:SAMPLE_TEXTS]
        # Only the counts that the sample's words and their look-alikes may need.
        need = {w for t in texts for w in TOKEN.findall(t.lower())} | {"-".join(p) for t in texts for c in COMPOUND.findall(t.lower()) for q in [c.split("-")] for p in zip(q, q[1:], strict=False)}
        spark = self.rows.sparkSession
        wanted = spark.createDataFrame([(w,) for w in sorted(need)], "form string") if need else None
        counts = {r.form: float(r.clean) for r in self.counts.join(F.broadcast(wanted), "form").select("form", "clean").collect()} if need else {}
        return train(texts, counts, self.total, seed)

    def misread(self, joined: bool = False) -> DataFrame:
        """(kind, id, form, fixed): the misread words of each row, and what they stood for; with `joined` also those broken at line ends."""
        shipped = self.rows.sparkSession.sparkContext.broadcast(bit_table(self.words))
        return self.rows.mapInArrow(_suspects(shipped, joined), "kind string, id bigint, form string").join(self.words, "form").select("kind", "id", "form", "fixed")

    def found(self) -> DataFrame:
        """(kind, id) of the rows with a broken word, a misread character, a running header or a page number."""
        pages = self.layout.where("pages > 0").select("kind", "id")
        joined = self.ends.where("join").select(F.struct("l", "m", "r").alias("b"))
        broken = self.layout.select("kind", "id", F.explode("breaks").alias("b")).join(joined, "b", "left_semi").select("kind", "id")
        return pages.unionByName(broken).unionByName(self.misread().select("kind", "id")).distinct()

    def repaired(self) -> DataFrame:
        """(kind, id, text): every row as continuous paragraphs, by what was decided of its own words and line ends."""
        words = self.misread(joined=True).groupBy("kind", "id").agg(F.collect_set(F.struct("form", "fixed")).alias("words"))
        split = self.ends.where("NOT join").select(F.struct("l", "m", "r").alias("b"))
        kept = self.layout.select("kind", "id", F.explode("breaks").alias("b")).join(split, "b", "left_semi").groupBy("kind", "id").agg(F.collect_set("b").alias("kept"))
        rows = self.rows.join(words, ["kind", "id"], "left").join(kept, ["kind", "id"], "left")
        return rows.select("kind", "id", "text", "words", "kept").mapInArrow(_repaired(self.models["lines"]), "kind string, id bigint, text string")


def _like(fixed: str, word: str) -> str:
    """A corrected form in the case of the word it replaces."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return fixed.upper()
    return fixed[:1].upper() + fixed[1:] if letters and word[0].isupper() else fixed


def repair_text(text: str, words: dict[str, str], split: set, lines: dict[str, float]) -> str:
    """One text without furniture, broken words and misread forms, its lines joined into paragraphs."""
    if not text.strip():
        return text
    paged = wrapped(text) or "\f" in text
    out, at = [], 0
    for a, b in furniture(text, lines):
        out.append(text[at:a])
        at = b
        while at < len(text) and text[at] in "\r\n\f":
            at += 1
    text = "".join([*out, text[at:]]).replace("\f", "\n")

    def end(m: re.Match) -> str:
        compound = (m[1].lower(), mark_of(m[2], m[3]), m[4].lower()) in split
        return f"{m[1]}-{m[4]}" if compound else m[1] + m[4]

    before = None
    while before != text:  # a word may be broken twice
        before, text = text, BREAK.sub(end, text)
    if words:
        text = TOKEN.sub(lambda m: _like(words[m[0].lower()], m[0]) if m[0].lower() in words else m[0], text)
    if paged:
        text = "\n\n".join(re.sub(r"(?<![\n])[ \t]*\r?\n[ \t]*", " ", p).strip() if not is_list(p) else p for p in re.split(r"\n[ \t]*\n\s*", text))
    return text


def is_list(paragraph: str) -> bool:
    """Whether a paragraph's lines stand for themselves: short first line (a heading) or rows of a table or list."""
    rows = paragraph.split("\n")
    return len(rows) > 1 and (sum("\t" in r or "|" in r for r in rows) > len(rows) / 2 or max(map(len, rows)) < 30)
