"""Personal information in free text: a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import functools
import itertools
import random
import re
from collections.abc import Callable, Iterable, Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: The longest segment, in code points.
MAX_LENGTH = 96
#: Labelled texts that are made for training, rounds over them, and the variance of the Gaussian prior.
TRAIN_TEXTS, ROUNDS, VARIANCE, SEED = 900, 25, 4.0, 11
#: Full names that the tasks are sent as a whole at most; of more, each text gets those parts that occur in it, by a join.
GAZETTEER_LIMIT = 50_000

# Words that announce a kind before or after a segment.
CUES = {
    "phone": "call|text me|phone|tel|mobile|landline|number|fax|dial|ring|llám|teléfono|ruf|telefon|handy|anruf|appel|电话|手机|号码|打|拨|致电|電話",
    "id": "ssn|social security|passport|national id|identity|id no|id card|id number|travel document|licen[cs]e|dni|nie|documento|pasaporte|ausweis|reisepass|证件|身份证|护照|编号|番号|旅券|carte d'identité",
    "address": "live|moved|pickup|parcel|send|ship|deliver|address|wohn|adresse|vive|vivo|envía|dirección|住|寄|地址|搬|送|habite",
    "name": r"ask for|called|named|contact|holder|landlord|landlady|tenant|name is|mrs?|ms|signed by|heißt|herrn?|frau|vermieter|mieter|llama|pregunta por|dueñ[oa]|señora?|s'appelle|联系人|收件人|房东|叫|姓名|名字|找|签收|さん|氏名",
    "order": "order|ticket|invoice|build|version|room|score|parcel no|tracking|serial|sku|page|it cost|took|pedido|factura|bestellung|rechnung|单号|订单|版本|发票|快递单|房间|比分|注文",
}
# What follows a name that acts or is addressed.
AFTER_NAME = r"\s+(?:signed|called|lives|is the|will pick|has the|wohnt|vive|firmó|hat unterschrieben|at the desk)|签收|女士|先生|さん"
# Words that end a street's name, by language.
STREET_EN = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Row|Close|Court|Ct|Drive|Dr|Way|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Hill|Crescent|Gardens|Walk|Mews|Parade|Grove"
STREET_DE = "straße|strasse|str\\.|gasse|weg|platz|allee|ufer|damm|ring|steig|graben"
STREET_ES = "Calle|C/|Avenida|Avda\\.|Av\\.|Plaza|Paseo|Camino|Carrer|Rua|Travessa"
STREET_FR = "rue|avenue|boulevard|place|chemin|impasse|allée|quai"
STREET_ZH = "路|街|大道|巷|弄|胡同|道"

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0x00A0: 0x20, 0x2007: 0x20, 0x2009: 0x20, 0x202F: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D}
_CUE = {k: re.compile(rf"(?<![A-Za-zà-ÿ])(?:{w})", re.IGNORECASE) for k, w in CUES.items()}
_AFTER = re.compile(AFTER_NAME, re.IGNORECASE)
_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_])?@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_SPELLED = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+\-]* ?(?:\(at\)|\[at\]|\{at\}| at |＠) ?[A-Za-z0-9\-]+(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?|\.)[A-Za-z0-9\-]+)*?(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?|\.)[A-Za-z]{2,}(?: dot [A-Za-z]{2,})*", re.IGNORECASE)
_RUN = re.compile(r"(?<![A-Za-z0-9_.@+\-/])[+(]?\d(?:[\d ()./\-]{4,28})\d(?![A-Za-z0-9_@])")
_GROUP = re.compile(r"\d+")
_CODES = {
    "letters digits": re.compile(r"(?<![A-Za-z0-9_\-.@+])[A-Z]{1,3} ?\d{6,9}(?![A-Za-z0-9_@\-])"),
    "digits letter": re.compile(r"(?<![A-Za-z0-9_\-.@+])(?:[XYZ]\d{7}|\d{7,9})-?[A-Z](?![A-Za-z0-9_@\-])"),
    "pairs": re.compile(r"(?<![A-Za-z0-9_\-.@+])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![A-Za-z0-9_@\-])"),
    "eighteen": re.compile(r"(?<![A-Za-z0-9_\-.@+])\d{17}[\dXx](?![A-Za-z0-9_@\-])"),
    "three two four": re.compile(r"(?<![A-Za-z0-9_\-.@+])\d{3}[- ]\d{2}[- ]\d{4}(?![A-Za-z0-9_@\-])"),
}
_UNIT = r"(?:,? ?(?:Apt|Unit|Flat|Suite|Floor|No)\.? ?[0-9A-Za-z\-]{1,5})?"
_PLACES = {
    "english": re.compile(rf"(?<![A-Za-z0-9\-])\d{{1,5}}[A-Za-z]?,? (?:[A-Z][A-Za-z'’\-]+ ){{1,3}}(?i:{STREET_EN})\b\.?{_UNIT}"),
    "german": re.compile(rf"(?:[A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ\-]+ )?[A-ZÄÖÜ][A-Za-zäöüÄÖÜß\-]*?(?i:{STREET_DE})\s+\d{{1,4}} ?[a-z]?(?![A-Za-z0-9])"),
    "spanish": re.compile(rf"(?i:{STREET_ES}) ?(?:(?:de|del|la|las|los|el|da|do|dos|das) )*[A-ZÁÉÍÓÚÑ][\w’'\-]*(?: (?:de |del |la )?[A-ZÁÉÍÓÚÑ][\w’'\-]*){{0,3}},? (?:n\.?[ºo°] ?)?\d{{1,4}}(?![0-9])"),
    "french": re.compile(rf"(?<![A-Za-z0-9\-])\d{{1,4}}(?: ?bis| ?ter)?,? (?i:{STREET_FR}) (?:de la |de l['’]|du |des |de |d['’])?[A-ZÀ-Ý][\wÀ-ÿ'’\-]+(?: [A-ZÀ-Ý][\wÀ-ÿ'’\-]+){{0,2}}"),
    "japanese": re.compile(r"[一-鿿ぁ-んァ-ヶ]{2,10}\d{1,3}丁目\d{1,3}(?:番地?|-)\d{0,3}号?"),
}
_HAN_PLACE = re.compile(rf"(?:{STREET_ZH}) ?\d{{1,5}} ?(?:号|弄|號)(?:[0-9A-Za-z\-]{{1,4}}(?:号楼|栋|幢|单元|层|楼|室|号)){{0,4}}")
_HAN_BEFORE = re.compile(r"(?:住在|寄到|送到|搬到|住|寄|送|地址是|地址|家在|在|到|是|于|去)$")
_WORD = r"[A-ZÀ-Þ][a-zß-ÿ]+(?:['’][A-Z]?[a-zß-ÿ]+)?(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?"
_LOUD = r"[A-ZÀ-Þ]{3,}(?:-[A-ZÀ-Þ]{2,})?"
_NAME = re.compile(rf"(?<![\w@.\-])(?:{_WORD}(?: (?:van|von|de|del|la|[A-Z]\.))? {_WORD}|{_WORD}, {_WORD}|{_LOUD} {_LOUD}|{_LOUD}, {_LOUD})(?![\w@])")
_HAN_NAME = re.compile(r"(?:联系人|收件人|房东叫|房东是|名字叫|姓名|签收人|我叫|叫做|叫)[：:是 ]{0,2}([一-鿿]{2,4})(?=$|[\s，。,.;；!！?？、）)/\-—])")
_HINT = re.compile(r"[@0-9]| dot |\(dot\)|\[dot\]", re.IGNORECASE)

#: Feature names by kind; each kind has a bias of its own.
Features = list[str]
Segment = tuple[int, int, str, Features]


def name_parts(name: str) -> list[str]:
    """What a full display name adds to the gazetteer, each part behind its kind: w(ord), n(ame), h(ead) and t(ail); nothing for handles."""
    if re.fullmatch(rf"{_WORD} {_WORD}", name):
        return [f"w{w.lower()}" for w in name.split()]
    if re.fullmatch(r"[一-鿿]{3}", name):
        return [f"n{name}", f"h{name[0]}", f"t{name[1:]}"]
    return []


class Gazetteer:
    """Given and family names that full display names consist of."""

    def __init__(self, names: Iterable[str], parts: Iterable[str] = ()):
        """Of full names, and of parts as :func:`name_parts` gives them."""
        kinds: dict[str, set[str]] = {"w": set(), "n": set(), "h": set(), "t": set()}
        for part in itertools.chain(parts, *map(name_parts, names)):
            kinds[part[0]].add(part[1:])
        self.words, self.han = kinds["w"], kinds["n"]
        some = kinds["h"] and kinds["t"]
        self.pattern = re.compile(rf"[{''.join(sorted(kinds['h']))}](?:{'|'.join(sorted(kinds['t']))})") if some else None

    def known(self, name: str) -> int:
        return sum(p.lower() in self.words for w in re.split(r"[ ,]+", name) for p in [w.split("-")[0]])


def _nearby(text: str, start: int, width: int = 26) -> Features:
    """The cue closest before a segment, unless a sentence or list item ends between."""
    left = re.split(r"[。！？!?\n;；]|\. | / | — ", text[max(0, start - width) : start])[-1]
    best = ("no cue", -1)
    for kind, pattern in _CUE.items():
        for m in pattern.finditer(left):
            if m.end() > best[1]:
                best = (f"{kind} cue", m.end())
    return [best[0]]


def candidates(text: str, gazetteer: Gazetteer) -> tuple[str, list[Segment]]:
    """The text in plain widths (of equal length), and every candidate segment with its features."""
    plain = text.translate(_WIDE)
    found: list[Segment] = []

    def add(start: int, end: int, kind: str, *names: str) -> None:
        if 0 < end - start <= MAX_LENGTH:
            found.append((start, end, kind, [f"{kind}: {n}" for n in ("bias", *names, *_nearby(plain, start))]))

    if _HINT.search(plain):
        if "@" in plain:
            for m in _EMAIL.finditer(plain):
                add(m.start(), m.end(), "email", "form")
        for m in _SPELLED.finditer(plain) if " dot " in plain or "(" in plain or "[" in plain else ():
            if not _EMAIL.fullmatch(m.group()) and re.search(r"dot|\(at\)|\[at\]", m.group(), re.IGNORECASE):
                add(m.start(), m.end(), "email", "spelled")
        for m in _RUN.finditer(plain):
            groups = list(_GROUP.finditer(plain, m.start(), m.end()))
            for i in range(len(groups)):
                digits = 0
                for j in range(i, min(i + 8, len(groups))):
                    digits += groups[j].end() - groups[j].start()
                    if digits > 20:
                        break
                    if digits < 7:
                        continue
                    whole = i == 0 and j == len(groups) - 1
                    start = m.start() if i == 0 and not (plain[m.start()] == "(" and plain.find(")", m.start(), m.start() + 8) < 0) else groups[i].start()
                    first, inner = plain[start], plain[start : groups[j].end()]
                    end = groups[j].end()
                    sizes = "-".join(str(g.end() - g.start()) for g in groups[i : j + 1])
                    opened = "plus" if first == "+" else "bracket" if first == "(" else "zero" if plain[groups[i].start()] == "0" else "digit"
                    length = "short" if digits < 9 else "usual" if digits <= 13 else "long"
                    add(start, end, "phone", length, f"starts with {opened}", "whole run" if whole else "part of run", "ten digits" if sizes == "10" else "one group" if i == j else "grouped", *(["3-2-4"] if sizes == "3-2-4" else ["3-3-4"] if sizes.endswith("3-3-4") else []), *(["dotted"] if "." in inner else []))
                    if whole and first.isdigit():
                        add(start, end, "id_number", "plain digits", length, *(["grouped"] if i != j else []))
        for form, pattern in _CODES.items():
            for m in pattern.finditer(plain):
                add(m.start(), m.end(), "id_number", form)
        for language, pattern in _PLACES.items():
            for m in pattern.finditer(plain):
                add(m.start(), m.end(), "address", language)
        for m in _HAN_PLACE.finditer(plain):
            for size in range(1, 7):
                start = m.start() - size
                if start < 0 or not "一" <= plain[start] <= "鿿":
                    break
                led = _HAN_BEFORE.search(plain, max(0, start - 4), start)
                add(start, m.end(), "address", "han", "led to" if led else "begins" if start == 0 or not "一" <= plain[start - 1] <= "鿿" else "continues", f"street of {min(size, 4)}")
    spans = {}
    cued = _CUE["name"].search(plain) is not None
    for m in _NAME.finditer(plain):
        known = gazetteer.known(m.group())
        follow = _AFTER.match(plain, m.end()) is not None
        if known or follow or cued and _nearby(plain, m.start())[0] == "name cue":
            spans[m.start(), m.end()] = [f"{min(known, 2)} known", "acts" if follow else "does not act", "comma" if "," in m.group() else "loud" if m.group().isupper() else "words"]
            last = re.split(r"[ ,]+", m.group())[-1]
            if re.fullmatch(STREET_EN, last, re.IGNORECASE) or re.search(rf"(?i:{STREET_DE})$", last):
                spans[m.start(), m.end()].append("street")
    if not plain.isascii():
        for m in _HAN_NAME.finditer(plain):
            spans[m.start(1), m.end(1)] = ["han", "announced", "2 known" if m.group(1) in gazetteer.han else "0 known"]
        if gazetteer.pattern:
            for m in gazetteer.pattern.finditer(plain):
                spans.setdefault((m.start(), m.end()), ["han", "2 known", "not announced"])
    for (a, b), names in spans.items():
        add(a, b, "name", *names)
    return plain, found


def _positions(segments: list[Segment]) -> tuple[list[int], dict[int, int], dict[int, list[int]]]:
    places = sorted({p for s in segments for p in s[:2]})
    index = {p: i for i, p in enumerate(places)}
    ending: dict[int, list[int]] = {}
    for k, s in enumerate(segments):
        ending.setdefault(index[s[1]], []).append(k)
    return places, index, ending


def decode(segments: list[Segment], weights: dict[str, float]) -> list[Segment]:
    """The best set of segments that do not overlap, by dynamic programming over their boundaries."""
    if not segments:
        return []
    scores = [sum(weights.get(f, 0.0) for f in s[3]) for s in segments]
    places, index, ending = _positions(segments)
    best: list[tuple[float, int | None]] = [(0.0, None)]
    for i in range(1, len(places)):
        top: tuple[float, int | None] = (best[i - 1][0], None)
        for k in ending.get(i, ()):
            value = best[index[segments[k][0]]][0] + scores[k]
            if value > top[0]:
                top = (value, k)
        best.append(top)
    out, i = [], len(places) - 1
    while i > 0:
        k = best[i][1]
        if k is None:
            i -= 1
        else:
            out.append(segments[k])
            i = index[segments[k][0]]
    return out[::-1]


def _gradient(segments: list[Segment], gold: set[tuple[int, int, str]], weights: dict[str, float], into: dict[str, float]) -> float:
    """Adds the gradient of the log-likelihood of ``gold`` and returns the log-likelihood."""
    scores = [sum(weights.get(f, 0.0) for f in s[3]) for s in segments]
    places, index, ending = _positions(segments)
    starting: dict[int, list[int]] = {}
    for k, s in enumerate(segments):
        starting.setdefault(index[s[0]], []).append(k)
    n = len(places)
    forward, backward = [1.0] + [0.0] * (n - 1), [0.0] * (n - 1) + [1.0]
    weight = [exp(min(30.0, x)) for x in scores]
    for i in range(1, n):
        forward[i] = forward[i - 1] + sum(forward[index[segments[k][0]]] * weight[k] for k in ending.get(i, ()))
    for i in range(n - 2, -1, -1):
        backward[i] = backward[i + 1] + sum(backward[index[segments[k][1]]] * weight[k] for k in starting.get(i, ()))
    total, chosen = forward[-1], 0.0
    for k, s in enumerate(segments):
        right = (s[0], s[1], s[2]) in gold
        chosen += scores[k] * right
        change = right - forward[index[s[0]]] * weight[k] * backward[index[s[1]]] / total
        for f in s[3]:
            into[f] = into.get(f, 0.0) + change
    return chosen - log(total)


# Invented sentences that carry a kind in braces, and sentences that carry none.
CARRIERS = [
    "call {phone} after lunch", "new number: {phone}", "text me ({phone}) if the gate is locked", "landline is {phone}, mornings only", "Tel. {phone}", "{phone}", "my phone: {phone}", "ruf mich unter {phone} an", "llámame al {phone}", "电话是{phone}，晚上打", "打{phone}找我", "手机 {phone}", "{phone}, evenings",
    "write me at {email} when it ships", "CC {email} please", "邮箱换成{email}了", "schreib an {email}", "escríbeme a {email}", "forwarded by {email}", "<mailto:{email}>", "{email}", "my inbox is {email} now", "请发到{email}",
    "SSN {id_number}, needed for the form", "the desk wants social security no.: {id_number}", "passport {id_number}", "national id {id_number}", "identity card {id_number}, bring it", "travel document: {id_number}", "mi DNI es {id_number}", "mi documento es {id_number}", "Personalausweis {id_number}", "身份证号：{id_number}", "护照号{id_number}，登记要用", "证件号{id_number}", "ID no. {id_number}",
    "we moved, it's {address} now", "pickup is at {address} as usual", "send the parcel to {address}", "wir wohnen jetzt {address}", "envíalo a {address}", "我住在{address}，别走错", "快递寄到{address}", "he lives at {address}", "{address}",
    "ask for {name} at the desk", "the landlord is called {name}", "contract holder: {name}", "der Vermieter heißt {name}", "la dueña se llama {name}", "pregunta por {name}", "联系人：{name}", "房东叫{name}", "{name} signed for the parcel", "{name}签收了快递", "thanks, {name}", "{name} told me so",
]
PLAIN = [
    "order {n4}-{n2}-{n3} still shows as pending", "单号{n4}-{n3}还没发货", "invoice {n4}-{n4}-{n2} has no phone on it", "ticket TCK-{n2}-{n5} covers it", "room {n4} is free until {n1}:{n2}", "build v{n2}.{n2}.{n2} crashes", "order {n10} is late", "invoice {n8}", "version {n2}.{n4}.{n4}", "tracking {n4}-{n4}-{n4}", "订单{n10}已发货", "the score was {n3}-{n4}",
    "{street} is noisy this week", "call me after lunch", "邮箱暂时用不了", "地址还没定，等通知", "I parked the passport next to {place}, remind me", "你还记得我说过的护照吗", "pickup at {n1}:{n2}", "{place}, {place} and {place} came", "see you in {place} then", "ask for {place} at the desk", "it is called {place} {street}", "{place} said {n2} but meant {n2}", "Understood. I moved it to Friday {n1}:{n2}",
]


def training_texts(count: int = TRAIN_TEXTS, seed: int = SEED) -> tuple[list[tuple[str, set[tuple[int, int, str]]]], list[str]]:
    """Labelled texts made from the carriers, and the display names their gazetteer is made of (half of the names used)."""
    r = random.Random(seed)
    syllable = lambda: r.choice("bcdfghklmnprstvz") + r.choice("aeiou")
    word = lambda n=0: "".join(syllable() for _ in range(n or r.choice([2, 3]))).title() + r.choice(["", "n", "r", "th", "l"])
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    han = lambda n: "".join(chr(r.randrange(0x5200, 0x8F00)) for _ in range(n))
    people = [(word(), word()) for _ in range(60)]
    hans = [han(3) for _ in range(40)]
    listed = [" ".join(p) for p in people[:30]] + hans[:20]

    def number() -> str:
        return r.choice([f"+{digits(2)} {digits(2)} {digits(5)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(4)} {digits(3)} {digits(3)}", f"0{digits(2)} / {digits(5)}-{digits(3)}", f"{digits(3)}.{digits(3)}.{digits(4)}", "2" + digits(9), f"+44 {digits(4)} {digits(6)}", f"01 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", "13" + digits(9), f"+{digits(2)} {digits(3)} {digits(4)} {digits(4)}"])

    def mailbox() -> str:
        user, host, top = word().lower() + r.choice([".", "-", "_", ""]) + word().lower(), word().lower(), r.choice(["example", "test", "org"])
        return r.choice([f"{user}@{host}.{top}"] * 4 + [f"{user} at {host} dot {top}", f"{user} (at) {host}.{top}", f"{user}[at]{host}[dot]{top}"])

    def identity() -> str:
        return r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", digits(18), digits(17) + "X", "XZ" + digits(7), digits(8) + r.choice("KLMT"), f"QQ {digits(2)} {digits(2)} {digits(2)} {r.choice('ABC')}", "E" + digits(8), digits(9)])

    def place() -> str:
        return r.choice([f"{r.randrange(1, 180)} {word()} {r.choice(['Street', 'Road', 'Lane', 'Row', 'Avenue', 'Close'])}", f"{r.randrange(1, 180)} {word()} {word()} {r.choice(['Road', 'Street'])}, Apt {r.randrange(1, 30)}", f"{word()}straße {r.randrange(1, 90)}a", f"Alte {word()}gasse {r.randrange(1, 90)}", f"Calle del {word()} {word()} {r.randrange(1, 200)}", f"{r.randrange(1, 90)} rue de {word()}", f"{han(2)}路{r.randrange(1, 190)}号{r.randrange(1, 9)}栋{r.randrange(101, 900)}室", f"{han(2)}大道{r.randrange(1, 190)}号"])

    def person(chinese: bool) -> str:
        if chinese:
            return r.choice(hans)
        a, b = r.choice(people)
        return r.choice([f"{a} {b}", f"{a} {b}", f"{b}, {a}", f"{a} {b}".upper(), f"{a} {b}-{word()}"])

    texts = []
    for _ in range(count):
        text, gold = "", set()
        for _ in range(r.choice([1, 1, 2, 3])):
            if text:
                text += r.choice([". ", " / ", "; ", "\n", " — "])
            form = r.choice(CARRIERS if r.random() < 0.6 else PLAIN)
            for piece in re.split(r"(\{\w+\})", form):
                if not piece.startswith("{"):
                    text += piece
                    continue
                slot = piece[1:-1]
                value = (
                    number() if slot == "phone" else mailbox() if slot == "email" else identity() if slot == "id_number" else place() if slot == "address"
                    else person(form.startswith(("联", "房")) or "签收" in form) if slot == "name" else word(3) if slot == "place" else f"{word()} {r.choice(['Lane', 'Road', 'Row'])}" if slot == "street" else digits(int(slot[1:]))
                )
                if slot in KINDS:
                    gold.add((len(text), len(text) + len(value), slot))
                text += value
        texts.append((text, gold))
    return texts, listed


@functools.cache
def trained_weights(count: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> dict[str, float]:
    """Weights by adaptive gradient ascent on the log-likelihood of the labelled texts, with a Gaussian prior."""
    texts, listed = training_texts(count)
    gazetteer = Gazetteer(listed)
    lattices = [(s, gold) for t, gold in texts if (s := candidates(t, gazetteer)[1])]
    weights: dict[str, float] = {}
    power: dict[str, float] = {}
    for _ in range(rounds):
        for at in range(0, len(lattices), 30):
            slope: dict[str, float] = {}
            for segments, gold in lattices[at : at + 30]:
                _gradient(segments, gold, weights, slope)
            for f, g in slope.items():
                g -= weights.get(f, 0.0) * 30 / len(lattices) / VARIANCE
                power[f] = power.get(f, 1e-6) + g * g
                weights[f] = weights.get(f, 0.0) + 0.7 * g / power[f] ** 0.5
    return weights


def segments(text: str, gazetteer: Gazetteer, weights: dict[str, float]) -> list[Segment]:
    return decode(candidates(text, gazetteer)[1], weights)


def _text_parts(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function (n, text) -> (n, part): everything in a text that may be a part of a known name."""
    for batch in texts:
        rows, parts = [], []
        for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain = (t or "").translate(_WIDE)
            found = {f"w{p.split('-')[0].lower()}" for m in _NAME.finditer(plain) for p in re.split(r"[ ,]+", m.group())}
            for m in re.finditer(r"[一-鿿]+", plain):
                run = m.group()
                found |= {f"h{c}" for c in run} | {f"t{run[i:i + 2]}" for i in range(len(run) - 1)} | {f"n{run[i:i + 3]}" for i in range(len(run) - 2)}
            rows += [n] * len(found)
            parts += sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(parts, pa.string())], names=["n", "part"])


def _listed_parts(names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in names:
        yield pa.RecordBatch.from_arrays([pa.array([p for n in batch.column(0).to_pylist() for p in name_parts(n)], pa.string())], names=["part"])


def with_gazetteer(df: DataFrame, text: str, identities: DataFrame | None, column: str = "display_name", limit: int | None = None) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[Gazetteer]]]:
    """``df``, and what gives the gazetteer of each row of one of its batches.

    Up to ``limit`` distinct names are sent to the tasks as they are, and ``df``
    stays as it is. Of more, the parts that occur in a text are found by an
    equi-join with the parts of all names and stand in a further column
    ``__known``, the last; what is found in the texts is the same.
    """
    limit = GAZETTEER_LIMIT if limit is None else limit
    if identities is None:
        empty = Gazetteer([])
        return df, lambda batch: itertools.repeat(empty, batch.num_rows)
    names = identities.select(F.col(column).alias("n")).where(F.col("n").isNotNull()).distinct()
    few = names.limit(limit + 1).collect()
    if len(few) <= limit:
        whole = Gazetteer(r.n for r in few)
        return df, lambda batch: itertools.repeat(whole, batch.num_rows)
    numbered = cut(df.withColumn("__n", F.monotonically_increasing_id()))
    parts = names.mapInArrow(_listed_parts, "part string").distinct()
    met = numbered.select(F.col("__n").alias("n"), F.col(text).alias("text")).mapInArrow(_text_parts, "n bigint, part string").join(parts, "part", "left_semi")
    known = met.groupBy(F.col("n").alias("__n")).agg(F.collect_set("part").alias("__known"))
    joined = numbered.join(known, "__n", "left").drop("__n")
    return joined, lambda batch: (Gazetteer([], k or []) for k in batch.column("__known").to_pylist())


def personal_segments(df: DataFrame, row_id: str, text: str, identities: DataFrame | None = None) -> DataFrame:
    """(id, kind, start_char, end_char, value) of every piece of personal information in a text.

    Offsets are code points of the text as it is. Null and empty texts have
    none, texts of any length are searched whole, repeated rows are searched
    alike, an empty table gives no rows and further columns are not read. A
    name has a given and a family name, an address a street and a house
    number; passport numbers are id_number.

    Patterns only propose segments, which may overlap and differ in kind; a
    semi-Markov random field scores each as a whole by its form, the words
    before it and the names that full display names consist of, and dynamic
    programming chooses boundaries and kinds together.
    """
    weights = trained_weights()
    base, gazetteers = with_gazetteer(df.select(F.col(row_id).cast("string").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0), "text", identities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), gazetteers(batch), strict=True):
                out += [(i, kind, a, b, t[a:b]) for a, b, kind, _ in segments(t, g, weights)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "kind", "start_char", "end_char", "value"])

    return base.mapInArrow(run, "id string, kind string, start_char int, end_char int, value string")


def personal_kinds(df: DataFrame, row_id: str, text: str, identities: DataFrame | None = None) -> DataFrame:
    """(id, kind), one row per row and kind that occurs in it; see :func:`personal_segments`. Nothing is shuffled."""
    weights = trained_weights()
    base, gazetteers = with_gazetteer(df.select(F.col(row_id).cast("string").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0), "text", identities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = [], []
            for i, t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), gazetteers(batch), strict=True):
                here = sorted({s[2] for s in segments(t, g, weights)})
                ids += [i] * len(here)
                kinds += here
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string())], names=["id", "kind"])

    return base.mapInArrow(run, "id string, kind string")


def redact(df: DataFrame, text: str, identities: DataFrame | None = None) -> DataFrame:
    """``df`` with each piece of personal information in ``text`` replaced by its kind's placeholder; null stays null."""
    weights = trained_weights()
    base, gazetteers = with_gazetteer(df, text, identities)
    place, width = df.columns.index(text), len(df.columns)

    def clean(t: str | None, gazetteer: Gazetteer) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for a, b, kind, _ in segments(t, gazetteer, weights):
            out += [t[at:a], PLACEHOLDERS[kind]]
            at = b
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t, g) for t, g in zip(batch.column(place).to_pylist(), gazetteers(batch), strict=True)], pa.string())
            yield batch.set_column(place, batch.schema.names[place], texts).select(range(width))

    return base.mapInArrow(run, df.schema)
