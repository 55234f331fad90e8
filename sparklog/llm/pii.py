"""Personal data in whole texts: base patterns, and candidates judged by boosted trees.

Base spans are the checked matches of one pattern per kind. Beyond them, generators with
high recall propose overlapping candidates (obfuscated mail addresses, addresses of IP
version 6, telephone numbers without a country code, card numbers with odd separators);
a boosted-tree model over format and context features scores them, and those over their
kind's threshold are taken, best first, where they overlap nothing taken. Scores are calibrated,
and thresholds set for a stated precision, on examples that the trees did not see.

The model is trained here, on examples drawn from seeded templates (``EXAMPLES`` of
them), so it never depends on the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparklog.llm import runtime
from sparklog.llm.gbdt import BoostedTrees

# The kinds and their patterns.
KINDS = ("email", "ip", "card", "phone")
# The local part of an address is taken backwards from its sign, and an ip begins no run of digits but at its
# first, so a long unbroken text costs time in proportion; the matches are those of the plain patterns
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+).
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL = (re.compile("@"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"))
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Tests of whole columns: a text without any of these has no span.
HAS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9]([ -]?[0-9]){12}", "phone": r"\+[0-9]"}
EXAMPLES = 6000
#: A kind's threshold is the least score at which so many of the accepted examples that no tree saw are personal data.
PRECISION = 0.99


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(_digits(s)) <= 15


def _addresses(text: str, sign: re.Pattern, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping runs of LOCAL, a sign, and a domain."""
    last = 0
    for m in sign.finditer(text):
        if m.start() > last and (right := domain.match(text, m.end())):
            begin = last + len(text[last : m.start()].rstrip(LOCAL))
            if begin < m.start():
                yield begin, right.end()
                last = right.end()


def base_spans(text: str, kinds=KINDS) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches per kind without those that fail its check, by kind, then start."""
    by = {"ip": IP, "card": CARD, "phone": PHONE}
    return [(k, b, e) for k in KINDS if k in kinds for b, e in (_addresses(text, *EMAIL) if k == "email" else (m.span() for m in by[k].finditer(text))) if _valid(k, text[b:e])]


#: Kind, pattern (or sign and domain), and a cheap test of whole columns that holds wherever the pattern matches.
GENERATORS = [
    ("email", (re.compile(r" ?[\[({<] ?(?:at|AT|At|arroba|@) ?[\])}>] ?"), re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[({<] ?(?:dot|DOT|Dot|punkt|\.) ?[\])}>] ?|\.)[A-Za-z0-9-]++)+")), r"[\[({<] ?(at|AT|At|arroba|@) ?[\])}>]"),
    ("email", (re.compile(r" (?:at|AT) "), re.compile(r"[A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)+")), r" (at|AT) [A-Za-z0-9-]+ (dot|DOT) "),
    ("ip", re.compile(r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![0-9a-f:])"), r"[0-9a-fA-F]:[0-9a-fA-F]{0,4}:"),
    ("phone", re.compile(r"(?<![0-9.+/-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. /])[0-9]{3}[-. ][0-9]{4}(?![0-9-])"), r"[0-9]{3}[-. ][0-9]{4}"),
    ("phone", re.compile(r"(?<![0-9.+])00[1-9][0-9][0-9 ().-]{6,16}[0-9]"), r"00[1-9][0-9][0-9 ().-]"),
    ("card", re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"), r"[0-9]{4}[./_][0-9]{4}[./_]"),
]
HAS_CANDIDATE = "|".join(test for _, _, test in GENERATORS)
#: Words whose presence shortly before a candidate speaks for (or against) it.
CONTEXT = re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|tel|phone|call|fax|mobile|cell|ip|host|addr|address|server|card|visa|payment|credit|kontakt|telefon|correo)\b")
AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|invoice|ref|figure|page|section|ticket|build|serial|part|no|nr)\b")


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, b, e) for kind, g, _ in GENERATORS for b, e in (_addresses(text, *g) if isinstance(g, tuple) else (m.span() for m in g.finditer(text)))]


def features(text: str, kind: str, b: int, e: int) -> list[float]:
    s, before, after = text[b:e], text[max(0, b - 40) : b], text[e : e + 12]
    d = _digits(s)
    groups = [len(x) for x in re.findall("[0-9]+", s)]
    words = re.findall("[A-Za-z]+", s)
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(d), len(groups), max(groups, default=0), groups[-1] if groups else 0, len(set(d)),
        len(words), len(words[-1]) if words else 0, s.count(":"), s.count("-"), s.count("."), s.count(" "),
        float("(" in s), float("[" in s or "<" in s or "{" in s), float(luhn(d)) if d else 0.0, float(d[:1] in "456"), float(d[:1] in "01"),
        float(bool(CONTEXT.search(before))), float(bool(AGAINST.search(before))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "#$€v=/"),
        float(bool(re.search(r"(?i)(?:\.|dot[\])}>]? ?)(?:com|org|net|edu|gov|io|de|fr|es|uk)$", s))),
        float(s.lower() == s), float(bool(re.search("[a-f]", s)) and bool(d)), float("::" in s),
    ]


def _examples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates from templates: things that look like personal data, and things that nearly do."""
    r = np.random.default_rng(11)
    pick = lambda *x: x[int(r.integers(len(x)))]
    word = lambda lo=2, hi=9: "".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(lo, hi))))
    num = lambda k: "".join(str(int(c)) for c in r.integers(0, 10, k))
    text_of = lambda k: " ".join(word() for _ in range(k))
    hexa = lambda k: "".join("0123456789abcdef"[int(c)] for c in r.integers(0, 16, k))

    def card() -> str:
        d = pick("4", "5", "3") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def draw() -> tuple[str, str, int]:
        kind, good = pick(*KINDS), int(r.integers(2))
        if kind == "email":
            at, dot = pick((" [at] ", " [dot] "), ("[at]", "."), ("(at)", "(dot)"), (" at ", " dot "), ("<at>", "."))
            s = f"{word(3)}{pick('', '.' + word(), num(2))}{at}{word(3)}{dot}{pick('com', 'org', 'net', 'de', 'io')}"
            return kind, (s if good else f"{word()} at {word()} dot {word()}"), good
        if kind == "ip":
            s = pick(":".join(hexa(4) for _ in range(8)), f"2001:db8:{hexa(4)}::{hexa(2)}", f"fe80::{hexa(4)}:{hexa(4)}")
            return kind, (s if good else pick("::".join([num(1), num(2)]), f"{num(2)}::{num(2)}", f"{word(2, 3)[:2]}::{word(2, 4)[:2]}")), good
        if kind == "phone":
            a, b, c = pick("2", "3", "6", "7", "9") + num(2), pick("2", "4", "5", "8") + num(2), num(4)
            s = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0044 {num(2)} {num(4)} {num(4)}", f"0049-{num(3)}-{num(7)}")
            return kind, (s if good else pick(f"{pick('0', '1')}{num(2)}/{num(3)} {num(4)}", f"00{pick('1', '2')}{num(9)}", f"{a}.{num(3)} {c}", f"0{num(2)}-{num(3)}-{num(4)}")), good
        d = card() if good else num(16)
        return kind, pick(".", "/", "_").join(d[i : i + 4] for i in (0, 4, 8, 12)), int(good or luhn(d))

    x, y = [], []
    while len(y) < n:
        kind, s, good = draw()
        cue = pick("mail: ", "contact ", "call ", "tel. ", "ip ", "card ", "host ") if good and r.random() < 0.5 else pick("version ", "ref ", "order ", "no ") if not good and r.random() < 0.4 else ""
        before = text_of(5) + " " + cue
        text = before + s + pick(" ", ", ", ".") + text_of(3)
        got = [c for c in candidates(text) if c[0] == kind and c[1] >= len(before) - 1]
        for k, b, e in got[:1]:
            x.append(features(text, k, b, e))
            y.append(good)
    return np.array(x), np.array(y, float)


def calibrated(trees: BoostedTrees, x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Each kind's least score at which PRECISION of the accepted examples are personal data (over 1 if there is none)."""
    p, out = trees.predict(x), {}
    for i, kind in enumerate(KINDS):
        own = x[:, i] > 0
        order = np.argsort(-p[own], kind="stable")
        score, good = p[own][order], np.cumsum(y[own][order])
        last = np.append(score[1:] != score[:-1], True)  # equal scores are accepted together
        fine = np.flatnonzero(last & (good >= PRECISION * np.arange(1, len(score) + 1))) if len(score) else []
        out[kind] = float(score[fine[-1]]) if len(fine) else 1.1
    return out


@lru_cache(1)
def model() -> BoostedTrees:
    x, y = _examples(EXAMPLES)
    apart = np.arange(len(y)) % 4 == 3  # no tree and no calibration sees these
    trees = BoostedTrees().fit(x[~apart], y[~apart])
    trees.threshold = calibrated(trees, x[apart], y[apart])
    return trees


def more_spans(text: str, base: list[tuple[str, int, int]], trees: BoostedTrees) -> list[tuple[str, int, int]]:
    """Candidates over their threshold that overlap no base span, nor a better one."""
    found = sorted(set(candidates(text)))
    if not found:
        return []
    p = trees.predict(np.array([features(text, *c) for c in found]))
    taken = np.zeros(len(text), bool)
    for _, b, e in base:
        taken[b:e] = True
    out = []
    for i in np.argsort(-p, kind="stable"):
        k, b, e = found[i]
        if p[i] >= trees.threshold[k] and not taken[b:e].any():
            taken[b:e] = True
            out.append(found[i])
    return out


def find_pii(text: str, trees: BoostedTrees, kinds=KINDS, propose: bool = True) -> tuple[list, list]:
    """Base spans and all spans, each by kind, then start."""
    base = base_spans(text, kinds)
    full = base + (more_spans(text, base, trees) if propose else [])
    return base, sorted(full, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every stretch covered by spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for kind, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b >= at:
            out += [text[at:b], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _tests(text: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    has = {k: pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False) for k, p in HAS.items()}
    return has, pc.match_substring_regex(text, HAS_CANDIDATE).to_numpy(zero_copy_only=False)


def pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (null text: empty): ``doc_id``, base counts, ``base`` and ``spans`` as lists of
    kind, start, end, and the ``redacted`` text only where something was found (else null).

    Repeated rows each have their result, rows without an id none, an empty table gives no rows, and other
    columns are ignored. Of overlapping candidates the one of highest score is taken, of equal scores the first
    by kind and place. Time grows in proportion to a text."""
    spark = docs.sparkSession
    runtime.tune(spark)
    held = spark.sparkContext.broadcast(model())  # a fixed number of small trees
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", span), ("spans", span), ("redacted", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            text = batch.column(1)
            has, proposes = _tests(text)
            rows = []
            for i in range(batch.num_rows):
                kinds = [k for k in KINDS if has[k][i]]
                if not kinds and not proposes[i]:
                    rows.append((0, 0, 0, 0, [], [], None))
                    continue
                s = text[i].as_py()
                base, full = find_pii(s, trees, kinds, bool(proposes[i]))
                as_rows = [[dict(zip(("kind", "start", "end"), x)) for x in spans] for spans in (base, full)]
                rows.append((*(sum(x[0] == k for x in base) for k in KINDS), *as_rows, redact(s, full) if full else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, schema.types[1:]))], schema=schema)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    spans = "array<struct<kind: string, start: int, end: int>>"
    return runtime.texts(docs).mapInArrow(run, f"doc_id long, {kinds}, base {spans}, spans {spans}, redacted string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with all found spans redacted in ``text`` (and ``n_chars`` counted anew, if there is one); no row goes, order and other columns stay."""
    spark = docs.sparkSession
    runtime.tune(spark)
    held = spark.sparkContext.broadcast(model())
    names = docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            text = batch.column(at)
            has, proposes = _tests(text)
            flagged = np.nan_to_num(np.logical_or.reduce([*has.values(), proposes]).astype(float)).astype(bool)
            if flagged.any():
                out = text.to_pylist()
                sizes = batch.column(counted).to_pylist() if counted is not None else []
                for i in np.flatnonzero(flagged):
                    _, full = find_pii(out[i], trees, [k for k in KINDS if has[k][i]], bool(proposes[i]))
                    if full:
                        out[i] = redact(out[i], full)
                        if counted is not None:
                            sizes[i] = len(out[i])
                batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
                if counted is not None:
                    batch = batch.set_column(counted, batch.schema.field(counted), pa.array(sizes, batch.schema.field(counted).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
