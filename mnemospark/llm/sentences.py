"""Sentence boundaries in any language: candidates classified by maximum entropy, trained on reliable boundaries."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents from which the classifier learns at most, chosen by hash.
TRAIN_DOCS = 3000
#: Strength with which the weights are held to PRIOR, and the weight of all lessons together at most; both are needed, as the reliable places never show some features, such as small words after a closing quotation mark.
PRIOR_PRECISION, EVIDENCE = 2.0, 400.0

# Pairs of brackets and quotation marks.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“”", "‹": "›", "‘": "’", "‚": "‘’"}
# Abbreviations that lead on to what follows, by language.
LEADING = """
dr prof mr mrs ms mx rev hon gen col capt lt sgt sen rep gov st mt ft messrs vs viz cf e.g i.e approx
sr sra srta dra ud uds don dña av avda p.ej ej esq
hr hrn frl str z.b u.a d.h bzw ca evtl ggf vgl s.o s.u inkl
m mm mme mlle me env c.-à-d av.j.-c p.ex
डॉ श्री د
""".split()
# Abbreviations that refer to a number when one follows.
REFERRING = "no nos nr nro núm num n p pp pág págs s fig figs art abs kap cap ch sec vol bd ed eq op jan feb mar apr jun jul aug sep sept oct okt nov dec dez".split()
# Abbreviations that end a sentence as well as stand inside one.
EITHER = "etc usw a.m p.m inc ltd co corp bros jr ph.d m.d b.a m.a u.n u.s u.k e.u rd ave blvd gmbh e.v s.a al ss aa".split()
# Frequent German words that the other languages here do not have.
GERMAN = frozenset("der das und ist nicht mit am im dem den ein eine wir seit bei nach von zu für auf sich dass wird hat ich steht kommt".split())
# Frequent words that German does not have.
OTHER = frozenset("the and of to for with was that el la los las que una por le les du une pour est dans".split())

ENDS = ".!?。！？…।॥؟۔｡．‼⁇⁈⁉"
CLOSERS = frozenset(")]}\"'”’“»›」』）］】〕》〉")
_BLANK = re.compile(r"(?:[^\S\r\n]*(?:\r\n|\n|\r)){2,}")
_MARKS = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]")
_CANDIDATE = re.compile(rf"[{re.escape(ENDS)}](?:[{re.escape(ENDS)}]|(?<=\.) (?=\.))*")
#: Characters that a word before a mark does not have.
_APART = frozenset("()[]{}\"“”„«»「」『』（）,;:!?¿¡。！？、，：；")
_SPACE = re.compile(r"\s*")
_MEASURED = re.compile(r"\d\s[^\W\d_]+$")
_THAI = re.compile("[฀-๿]")
_THAI_SPACE = re.compile(r"(?<=\S)\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_DOTS = frozenset(".…．")
_LEAD, _REFER, _EITHER = frozenset(LEADING), frozenset(REFERRING), frozenset(EITHER)

#: What each feature weighs before training; the bias is its own feature.
PRIOR = {
    "strong": 4.0, "dot": 1.5, "ellipsis": 0.5, "closed": 0.0,
    "next upper": 1.0, "next lower": -6.0, "next digit": -0.5, "next caseless": 1.0, "next opens": 1.0, "next other": -2.0, "next joins": -9.0,
    "glued": -9.0, "glued start": 9.0,
    "leads": -7.0, "refers to digit": -6.0, "refers": -1.0, "either": 0.5, "initial": -6.0, "unit": 1.5, "short": -0.3, "dotted": -1.0, "number": -0.2, "german number": -5.0, "long": 0.3,
    "ellipsis before upper": 1.5, "ellipsis before caseless": 1.5, "ellipsis after one word": -6.0, "closed before caseless": -9.0, "strong before lower": -1.0,
}
NAMES = list(PRIOR)
INDEX = {n: i for i, n in enumerate(NAMES)}
PRIOR_WEIGHTS = np.array([PRIOR[n] for n in NAMES])


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def enclosed(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost spans (position of the opening mark, of the closing mark) of quotations and brackets that are closed in the block."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _MARKS.finditer(text, start, end):
        mark, at = m.group(), m.start()
        held = next((i for i in range(len(stack) - 1, -1, -1) if mark in stack[i][0]), None)
        if mark == "’" and held is not None and at + 1 < end and text[at + 1].isalnum() and text[at - 1].isalnum():
            continue
        if held is not None:
            spans.append((stack[held][1], at))
            del stack[held:]
        elif mark == '"':
            stack.append(('"', at))
        elif mark in PAIRS:
            stack.append((PAIRS[mark], at))
        elif mark == "»":
            stack.append(("«", at))
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s in spans:
        if not outer or s[0] > outer[-1][1]:
            outer.append(s)
    return outer


def _is_caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def is_german(text: str) -> bool:
    """Whether frequent German words prevail in a block."""
    words = [w.lower() for w in _WORD.findall(text)]
    here = sum(w in GERMAN for w in words)
    return here > 0 and here > sum(w in OTHER for w in words)


def _told_once(text: str, start: int, end: int) -> Callable[[], bool]:
    """Whether a block is German, found out when it is first asked for."""
    return functools.cache(lambda: is_german(text[start:end]))


def features(text: str, begin: int, place: tuple[int, int, int], end: int, german: Callable[[], bool]) -> list[str]:
    """Features of a candidate (start of its marks, their end, end of the closing marks) of a sentence from ``begin`` in a block that ends at ``end``."""
    at, marked, past = place
    marks, closed = text[at:marked], past > marked
    ellipsis = "…" in marks or ".." in marks or ". ." in marks
    strong = not ellipsis and bool(set(marks) - _DOTS)
    found = ["ellipsis" if ellipsis else "strong" if strong else "dot"]
    if closed:
        found.append("closed")
    after = _SPACE.match(text, past, end).end()
    spaced = after > past
    c = text[after] if after < end else ""
    if c.isdigit():
        nxt = "digit"
    elif c.isalpha():
        nxt = "upper" if c.isupper() or c.istitle() else "lower" if c.islower() else "caseless"
    elif c and c in "¿¡\"'“‘„«‹「『（([《【—–-#*•" and spaced:
        nxt = "opens"
    elif c and c in "¿¡“„「『《«\"(（【":
        # A closing mark would have been taken with the candidate, so one that adjoins it opens.
        nxt = "opens"
    elif c and c in ",;:、，；：%@/\\_=+&-–)]}»”’":
        nxt = "joins"
    else:
        nxt = "other"
    found.append(f"next {nxt}")
    left, least = at, max(begin, at - 32)
    while left > least and text[left - 1] not in _APART and not text[left - 1].isspace():
        left -= 1
    word = text[left:at]
    if not spaced and nxt in ("upper", "lower", "digit") and not (strong and nxt == "upper") and not closed and not _is_caseless(text[at - 1 : at]):
        found.append("glued")
        if nxt == "upper" and text[after + 1 : after + 2].islower() and (word.isdigit() or len(word) > 1 and word.isalpha() and word[-1].islower()):
            found.append("glued start")
    if ellipsis:
        if nxt in ("upper", "opens"):
            found.append("ellipsis before upper")
        if nxt == "caseless":
            found.append("ellipsis before caseless")
        if len(text[begin : at].split()) <= 1 and len(word) <= 4:
            found.append("ellipsis after one word")
        return found
    if closed and nxt == "caseless":
        found.append("closed before caseless")
    if strong:
        if nxt == "lower":
            found.append("strong before lower")
        return found
    if closed:
        return found
    low = word.lower()
    if low in _LEAD:
        found.append("leads")
    elif low in _REFER and nxt == "digit":
        found.append("refers to digit")
    elif low in _EITHER:
        found.append("either")
    elif word.islower() and len(word) <= 3 and _MEASURED.search(text, max(begin, at - 12), at):
        found.append("unit")
    elif low in _REFER and len(word) > 1:
        found.append("refers")
    elif len(word) == 1 and word.isalpha():
        found.append("initial")
    elif word and all(x.isdigit() or x == "." for x in word):
        found.append("number")
        if nxt in ("upper", "lower") and german():
            found.append("german number")
    else:
        if "." in word:
            found.append("dotted")
        found.append("short" if len(word) <= 3 else "long")
    return found


def _candidates(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Candidate boundaries of a block outside of quotations and brackets; see :func:`features`."""
    spans = enclosed(text, start, end)
    opening = {s[0] for s in spans}
    k = 0
    for m in _CANDIDATE.finditer(text, start, end):
        past = m.end()
        if past + 1 < end and text[past] in " \u00a0\u202f\u2009" and text[past + 1] in "»”":
            past += 1
        while past < end and text[past] in CLOSERS and past not in opening:
            past += 1
        past = max(past, m.end())
        while k < len(spans) and spans[k][1] < m.start():
            k += 1
        if k < len(spans) and spans[k][0] <= m.start() and past <= spans[k][1]:
            continue
        yield m.start(), m.end(), past


def _thai_ends(text: str, start: int, end: int) -> set[int]:
    """Ends before the spaces that end a sentence in Thai: beside a Thai letter, and beside no digit or Latin letter."""
    spans = enclosed(text, start, end)
    found = set()
    for m in _THAI_SPACE.finditer(text, start, end):
        a, b = text[m.start() - 1], text[m.end()] if m.end() < end else ""
        if not ("฀" <= a <= "๿" or "฀" <= b <= "๿"):
            continue
        if any(x.isdigit() or (x.isalpha() and x < "ɐ") for x in (a, b)):
            continue
        if not any(s[0] < m.start() <= s[1] for s in spans):
            found.add(m.start())
    return found


def split(text: str, weights: np.ndarray) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) in code points; see :func:`sentences`."""
    weight = dict(zip(NAMES, weights.tolist(), strict=True))
    out = []
    for start, end in blocks(text):
        german = _told_once(text, start, end)
        cuts: list[int] = []
        thai = _thai_ends(text, start, end) if _THAI.search(text, start, end) else set()
        marks = [(m[2], m) for m in _candidates(text, start, end)] + [(p, None) for p in thai]
        begin = start
        for at, m in sorted(marks, key=lambda x: (x[0], x[1] is None)):
            if at < begin:
                continue
            if m is not None and at < end:
                if sum(weight[f] for f in features(text, begin, m, end, german)) <= 0:
                    continue
            cuts.append(at)
            begin = _SPACE.match(text, at, end).end()
        begin = start
        for at in [*cuts, end]:
            piece = text[begin:at]
            lead = len(piece) - len(piece.lstrip())
            if lead < len(piece):
                out.append((begin + lead, begin + len(piece.rstrip())))
            begin = at
    return out


def lessons(text: str) -> Iterator[tuple[tuple[str, ...], bool]]:
    """(features, is boundary) at the reliable places of a text.

    A mark at the end of a block is a boundary, seen as if the next block's
    first letter followed. A mark before a comma, a small letter or a
    reference's digit is none; since case would give these away, such a place
    is also seen as if a capital followed, which teaches what words before the
    mark tell; not so after abbreviations that end sentences as well.
    """
    spans = list(blocks(text))
    for i, (start, end) in enumerate(spans):
        german = _told_once(text, start, end)
        for at, marked, past in _candidates(text, start, end):
            if _SPACE.match(text, past, end).end() == end:
                follow = text[spans[i + 1][0] : spans[i + 1][1]].lstrip()[:2] if i + 1 < len(spans) and past == marked else ""
                if follow:
                    joined = text[start:past] + " " + follow
                    yield tuple(features(joined, 0, (at - start, marked - start, past - start), len(joined), german)), True
                continue
            found = features(text, start, (at, marked, past), end, german)
            if "next lower" in found or "next joins" in found or "refers to digit" in found:
                yield tuple(found), False
                if "next lower" in found and "dot" in found and not {"glued", "either", "closed"} & set(found):
                    yield tuple("next upper" if f == "next lower" else f for f in found), False


def fit(counts: list[tuple[tuple[str, ...], bool, int]], precision: float = PRIOR_PRECISION, evidence: float = EVIDENCE) -> np.ndarray:
    """Maximum-entropy weights of counted lessons, which weigh ``evidence`` together at most, held to PRIOR by a Gaussian; without lessons they are PRIOR."""
    weights = PRIOR_WEIGHTS.copy()
    if not counts:
        return weights
    x = np.zeros((len(counts), len(NAMES)))
    for i, (names, _, _) in enumerate(counts):
        x[i, [INDEX[n] for n in names]] = 1
    y = np.array([float(b) for _, b, _ in counts])
    n = np.array([float(k) for _, _, k in counts])
    n *= min(1.0, evidence / n.sum())
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (y - p)) - precision * (weights - PRIOR_WEIGHTS)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + precision * np.eye(len(NAMES))
        step = np.linalg.solve(hessian, gradient)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def train(df: DataFrame, doc_id: str, text: str, limit: int = TRAIN_DOCS) -> np.ndarray:
    """Weights learnt from at most ``limit`` documents; only counts of feature sets come to the driver."""

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(lessons(t))
        rows = [("|".join(names), label, n) for (names, label), n in seen.items()]
        yield pa.RecordBatch.from_pydict({"names": pa.array([r[0] for r in rows], pa.string()), "label": pa.array([r[1] for r in rows], pa.bool_()), "n": pa.array([r[2] for r in rows], pa.int64())})

    order = F.xxhash64(F.col(doc_id))
    edge = df.where(F.length(F.trim(text)) > 0).select(order.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if edge is None:
        return PRIOR_WEIGHTS.copy()
    sample = df.where((order <= edge) & (F.length(F.trim(text)) > 0)).select(F.col(text))
    counted = sample.mapInArrow(teach, "names string, label boolean, n bigint").groupBy("names", "label").agg(F.sum("n").alias("n"))
    return fit([(tuple(r.names.split("|")), r.label, r.n) for r in sorted(counted.collect(), key=lambda r: (r.names, r.label))])


def sentences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence; offsets in code points, end exclusive.

    A sentence runs from its first to past its last non-space character,
    closing marks included. Blank lines always end one, single line breaks
    never by themselves; text inside a pair of quotation marks or brackets
    closed in the same block is not cut; a space in Thai cuts unless beside a
    digit or Latin letter. All other marks are candidates, each classified by
    a maximum-entropy model of the words, case, digits and script around it,
    learnt from the corpus's own reliable boundaries unless ``weights`` are
    given. Null, empty and blank texts have no sentence; repeated documents
    are cut alike; an empty table gives no rows; further columns are not read.
    """
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    learnt = train(base, "doc_id", "text") if weights is None else weights
    key = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, starts, ends = [], [], []
            for t in batch.column(1).to_pylist():
                found = split(t, learnt)
                counts.append(len(found))
                starts += [a for a, _ in found]
                ends += [b for _, b in found]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_char", "end_char"])

    return base.mapInArrow(run, f"doc_id {key}, start_char int, end_char int")
