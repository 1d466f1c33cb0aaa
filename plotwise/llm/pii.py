"""Personal data by weak supervision.

Four strict patterns find e-mail addresses, IP addresses, cards and phone numbers; their
matches always stay. Looser patterns propose further candidates, also inside runs that a
strict pattern took whole and then refused, such as a phone number that runs on into the
next number. On every candidate a set of labelers votes for, against or not at all: its
format, a checksum, gazetteers, and the words around it. Expectation-maximisation over the
counts of vote patterns of all documents estimates how reliable each labeler is on each
family of kinds, with all families together as the prior of each, and how likely each
pattern is personal data. Refused runs are candidates too, so that there is something to
tell personal data from; they are never added. A logistic span classifier is trained on
these likelihoods. It sees the votes and the shape of the span, which no labeler looks at,
and decides which proposals are added.

Null texts count as empty. Without any candidate nothing is learned or added. Proposals
that overlap a strict match, or one of a kind listed earlier, are not made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField

from plotwise.llm.batches import append_columns, slices
from plotwise.llm.spans import SPANS, free_of, in_order

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("world_phone", "grouped_card", "spelled_email", "local_phone", "national_id", "bank_account", "person", "street")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
#: Kinds whose labelers are judged together; any other kind is a family of its own.
FAMILY = {"world_phone": "phone", "local_phone": "phone", "grouped_card": "card", "spelled_email": "email"}
FAMILIES = tuple(k for k in KINDS if k not in FAMILY)
#: Probability from which a proposal is added.
CERTAIN = 0.95
#: Characters on either side that the context labelers read.
AROUND = 40
#: Candidates that all families together count for in the estimate of one family.
SHARED = 5.0
#: Fewest digits of a refused card that is looked at; shorter runs are plain numbers.
REFUSED_DIGITS = 12

# The strict patterns. A run of digits is taken whole, so a match never
# starts inside one.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

PROPOSED = {
    "world_phone": re.compile(r"\+(?:1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}"
                              r"|[2-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-][0-9]{2,4}){2,4})(?![0-9]|[.-][0-9])"),
    "grouped_card": re.compile(r"(?<![0-9])(?:[3-6][0-9]{3}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20-])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "spelled_email": re.compile(r"(?<![\w.])[\w.+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]+)+", re.A),
    "local_phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "bank_account": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "person": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?"),
    "street": re.compile(r"(?<!\w)[0-9]{1,5}\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd)(?!\w)"),
}

#: What a text must hold somewhere for a proposal to be possible; cheap to look for.
NEEDED = {
    "world_phone": re.compile(r"\+[0-9]"),
    "grouped_card": re.compile(r"[3-6][0-9]{3}[\x20-][0-9]{4}"),
    "spelled_email": re.compile(r"[\[(]at[\])]"),
    "local_phone": re.compile(r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"),
    "national_id": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "bank_account": re.compile(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "person": re.compile(r"[MDPHFS](?:r|rs|s|rof|err|rau|onsieur|adame|eñora?)\.?\x20"),
    "street": re.compile(r"[0-9]\x20[A-Z][a-z]+\x20[A-Z]"),
}

# Gazetteers.
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora".split())
FORENAMES = frozenset("""
    adam alan albert alexander alice amanda amy ana andrea andrew angela anita ann anna anne anthony antonio arthur
    barbara beatrice benjamin bernard betty brian camille carl carlos carmen carol caroline catherine charles charlotte
    christian christine christopher claire claudia claus cristina daniel david deborah denise dennis diana diego donald
    dorothy edward elena elizabeth emily emma eric erika eva felix fernando frances francis françois frank gabriel george
    gerhard hans heidi heinrich helen helmut henri henry ines inge isabel jack jacques james jan jane jean jennifer
    jessica joan john jorge josé joseph juan julia julie jürgen karen karl kevin klaus laura lisa louis lucas lucía luis
    manuel margaret maria maría marie mark martin mary michael michel miguel monika nancy nicolas olivier pablo patricia
    paul pedro peter philippe pierre rachel ralf richard robert rosa ruth sabine sandra sarah simon sofia stefan stephen
    susan thomas ursula uwe victor walter werner william wolfgang
""".split())
MAIL_ENDINGS = frozenset("""
    com org net edu gov mil int info biz io co me dev app ai cloud de at ch fr be lu nl es pt it pl cz se no dk fi ie uk
    eu us ca mx br ar cl au nz jp kr cn in za ru tr
""".split())
CALLING_CODES = frozenset("""
    1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91
    92 93 94 95 98 351 352 353 354 358 420 421
""".split())

FOR = {
    "email": re.compile(r"e-?mail|mail|contact|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|host|address|adresse|server|login", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf|téléphone|teléfono", re.I),
    "national_id": re.compile(r"\bssn\b|social|security|tax id|taxpayer", re.I),
    "bank_account": re.compile(r"iban|account|konto|compte|cuenta", re.I),
    "person": re.compile(r"dear|name|signed|attn|sincerely|born|patient", re.I),
    "street": re.compile(r"address|lives|live at|resid|ship|home", re.I),
}
FOR.update({kind: FOR[family] for kind, family in FAMILY.items()})
AGAINST = re.compile(r"version|isbn|issn|doi|figure|table|chapter|order|invoice|total|price|[$€£%=]", re.I)
LABELERS = ("format", "checksum", "gazetteer", "context", "counter_context", "neighbours")
#: Labelers that have nothing to say on a kind. Their silence there is no evidence.
SILENT = {
    "email": ("checksum",), "spelled_email": ("checksum",), "phone": ("checksum",), "world_phone": ("checksum",),
    "local_phone": ("gazetteer",), "national_id": ("format", "gazetteer"), "bank_account": ("gazetteer",),
    "person": ("checksum",), "street": ("checksum", "gazetteer"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[str, int, int, float]]:
    """Leftmost matches: the letters before each @ back to the last match, then a domain."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end(), 1.0))
            free = m.end()
        at = text.find("@", at + 1)
    return found


def matches(text: str) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int, int, float]]]:
    """Spans of the four strict patterns, and the runs they refused."""
    found, refused = emails(text), []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        held = all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
        (found if held else refused).append(("ip", *m.span(), 1.0))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= REFUSED_DIGITS and len(digits := m[0].replace(" ", "").replace("-", "")) >= REFUSED_DIGITS:
            held = 14 <= len(digits) <= 19 and luhn(digits)
            (found if held else refused).append(("card", *m.span(), 1.0))
    for m in PHONE.finditer(text):
        held = 10 <= sum(x.isdigit() for x in m[0]) <= 15
        (found if held else refused).append(("phone", *m.span(), 1.0))
    return found, refused


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    return matches(text)[0]


def proposals(text: str, taken: list) -> list[tuple[str, int, int, float]]:
    """Looser matches that neither a strict match nor an earlier proposal touches."""
    made, busy = [], list(taken)
    for kind, pattern in PROPOSED.items():
        if NEEDED[kind].search(text):
            new = [(kind, *m.span(), 0.0) for m in pattern.finditer(text) if free_of(busy, *m.span())]
            made += new
            busy += new
    return made


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """1 for, -1 against, 0 none, in the order of LABELERS."""
    value = text[start:end]
    before, after = text[max(0, start - AROUND): start], text[end: end + AROUND]
    digits = "".join(x for x in value if x in "0123456789")
    words = re.findall(r"\w+", value.lower())
    form = checksum = listed = 0
    if kind == "spelled_email":
        form = 1
        listed = 1 if words[-1] in MAIL_ENDINGS else -1
    elif kind == "email":
        form = 1 if value.count(".") <= 5 and not value.startswith((".", "-", "%")) else -1
        listed = 1 if words[-1] in MAIL_ENDINGS else -1
    elif kind == "ip":
        parts = value.split(".")
        form = -1 if any(len(p) > 1 and p.startswith("0") for p in parts) else 1
        checksum = 1 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        listed = -1 if value.startswith(("0.", "127.", "255.")) else 1
    elif kind in ("card", "grouped_card"):
        form = 1 if len(digits) in (15, 16) else -1
        checksum = 1 if luhn(digits) else -1
        listed = 1 if digits[0] in "3456" else -1
    elif kind in ("phone", "world_phone"):
        form = 1 if 11 <= len(digits) <= 13 else 0 if 10 <= len(digits) <= 15 else -1
        listed = 1 if any(digits.startswith(c) for c in CALLING_CODES) else -1
    elif kind == "local_phone":
        form = 1 if value.startswith("(") else 0
        checksum = -1 if digits[0] in "01" else 1
    elif kind == "national_id":
        area, group, serial = value.split("-")
        checksum = -1 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 1
    elif kind == "bank_account":
        code = value.replace(" ", "")
        moved = "".join(str(int(x, 36)) for x in code[4:] + code[:4])
        form, checksum = (1 if 15 <= len(code) <= 34 else -1), (1 if int(moved) % 97 == 1 else -1)
    elif kind == "person":
        named = [w for w in words if w not in TITLES]
        form = 1 if len(named) == 2 else 0
        listed = 1 if named and named[0] in FORENAMES else 0
    elif kind == "street":
        form = 1
    context = 1 if FOR[kind].search(before) or FOR[kind].search(after) else 0
    counter = -1 if AGAINST.search(before[-20:]) else 0
    glued = bool(re.search(r"[\w.-]$", before)) or bool(re.match(r"[\w-]", after))
    return form, checksum, listed, context, counter, -1 if glued else 1


def shape(text: str, start: int, end: int) -> tuple[int, ...]:
    """Small numbers that describe a span and what stands before it, one below each of SHAPES."""
    value = text[start:end]
    digits = sum(x in "0123456789" for x in value)
    parts = len(re.split(r"[\x20().@-]+", value))
    before = 0 if start == 0 else 1 if text[start - 1].isspace() else 2 if text[start - 1] in ":=\"'(<" else 3
    return min((end - start) // 4, 9), min(4 * digits // (end - start), 4), min(parts, 7), before


SHAPES = (10, 5, 8, 4)


@dataclass
class Model:
    """Estimated labelers by family, and the classifier; weights belong to ``features``."""

    right: dict[str, np.ndarray]
    weights: np.ndarray

    def probability(self, text: str, kind: str, start: int, end: int) -> float:
        z = float(features(kind, votes(text, kind, start, end), shape(text, start, end)) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(kind: str, cast: tuple[int, ...], form: tuple[int, ...]) -> np.ndarray:
    """Constant, family, whether each labeler voted for and against, and the shape."""
    v = np.array(cast)
    family = FAMILY.get(kind, kind)
    shapes = [np.arange(size) == value for size, value in zip(SHAPES, form)]
    return np.concatenate([[1.0], [float(k == family) for k in FAMILIES], v == 1, v == -1, *shapes])


def vote_sums(cast: np.ndarray, weight: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Sum of weights by labeler and vote, of the labelers asked."""
    return np.stack([((cast == v - 1) * asked * weight[:, None]).sum(axis=0) for v in range(3)], axis=1)


def estimate(cast: np.ndarray, count: np.ndarray, prior: np.ndarray | None = None,
             asked: np.ndarray | None = None, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation: share of personal data, chance of each vote, likelihood of each row.

    ``right[c, j, v]`` is the chance that labeler j votes v - 1 on class c, ``prior`` the
    votes of that kind counted beforehand, ``asked`` which labelers have a say on a row.
    The votes added up are where the likelihoods start.
    """
    asked = np.ones(cast.shape, bool) if asked is None else asked
    prior = np.ones((2, cast.shape[1], 3)) if prior is None else prior
    likely = 1 / (1 + np.exp(-1.5 * cast.sum(axis=1)))
    for _ in range(rounds):
        share = float(np.clip((likely * count).sum() / count.sum(), 0.01, 0.99))
        right = prior + np.stack([vote_sums(cast, count * (1 - likely), asked), vote_sums(cast, count * likely, asked)])
        right /= right.sum(axis=2, keepdims=True)
        log = np.log(right)
        each = [sum(asked[:, j] * log[c, j, cast[:, j] + 1] for j in range(cast.shape[1])) for c in (0, 1)]
        z = each[1] - each[0] + np.log(share / (1 - share))
        likely = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return share, right, likely


def fit(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]) -> Model | None:
    """The model of some (kind, votes, shape, count)."""
    if not patterns:
        return None
    cast = np.array([p[1] for p in patterns])
    count = np.array([p[3] for p in patterns], float)
    family = np.array([FAMILY.get(p[0], p[0]) for p in patterns])
    asked = np.array([[j not in SILENT.get(p[0], ()) for j in LABELERS] for p in patterns])
    _, together, _ = estimate(cast, count, asked=asked)
    right, likely = {}, np.empty(len(cast))
    for f in np.unique(family):
        rows = family == f
        _, right[str(f)], likely[rows] = estimate(cast[rows], count[rows], SHARED * together, asked[rows])
    x = np.array([features(k, v, form) for k, v, form, _ in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(100):  # Newton steps on the weighted, slightly shrunk logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (count * (p - likely)) + 0.1 * w
        curve = (x * (count * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        change = np.linalg.solve(curve, slope)
        w -= np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return Model(right, w)


def learn(docs: DataFrame, text: str = "text") -> Model | None:
    """Labelers and classifier from the candidates of all ``docs``.

    Executors reduce the candidates to counts of (kind, votes, shape), which are small
    numbers from fixed ranges, so the counts are bounded whatever the data; the estimates
    are made from these counts.
    """
    def gather(batches):
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                kinds, cast, forms = [], [], []
                for t in texts:
                    base, refused = matches(t or "")
                    for kind, start, end, _ in base + refused + proposals(t or "", base):
                        kinds.append(kind)
                        cast.append(list(votes(t, kind, start, end)))
                        forms.append(list(shape(t, start, end)))
                columns = [pa.array(kinds, pa.string()), pa.array(cast, pa.list_(pa.int32())), pa.array(forms, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "votes", "shape"])

    seen = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(gather, "kind string, votes array<int>, shape array<int>")
    counts = seen.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")).collect()
    return fit(sorted((r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["n"]) for r in counts))


def find(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: pattern matches, and proposals the classifier is certain of.

    The score of a span is the classifier's probability. A column named ``spans`` is
    replaced.
    """
    plain = None if model is None else (model.right, model.weights)

    def make():
        judge = None if plain is None else Model(*plain)

        def compute(texts):
            out = []
            for t in texts:
                base = base_spans(t or "")
                if judge is not None:
                    base = [(k, a, b, judge.probability(t, k, a, b)) for k, a, b, _ in base]
                    added = [(k, a, b, judge.probability(t, k, a, b)) for k, a, b, _ in proposals(t or "", base)]
                    base += [s for s in added if s[3] >= CERTAIN]
                out.append(in_order(base, KINDS))
            return [out]
        return compute

    return append_columns(docs, text, [StructField("spans", SPANS)], make)
