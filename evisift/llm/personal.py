"""Personal data by weak supervision.

Strict patterns give the base spans. Looser candidates (the strict ones among them) get votes from labelers that
know patterns, check sums, word lists and context; a labeler says yes, says no, or abstains. Expectation-maximisation
over the counts of vote patterns of the whole table estimates how far each labeler is to be trusted, without any label.
A logistic classifier on votes and shape learns the resulting probabilities and decides on candidates that are no base
spans. Only counts per pattern reach the driver, a number that the labelers bound, not the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisift.llm import arrays
from evisift.llm.spans import Marks, Span, digest, listed
from evisift.session import materialize

KINDS = ("email", "ip", "card", "phone", "account")
BASE_KINDS = KINDS[:4]

# The base patterns. A run of digits is matched from its first digit or not at all.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser shapes: spelled-out addresses, national telephone numbers, digit groups, bank accounts.
_SPELLED = re.compile(
    r"(?<!\S)[A-Za-z0-9._%+-]{2,40}\x20?[\[(]?\x20?(?:at|@|arroba)\x20?[\])]?\x20?[A-Za-z0-9-]{2,40}"
    r"(?:\x20?[\[(]?\x20?(?:dot|punto|punkt|point)\x20?[\])]?\x20?[A-Za-z0-9-]{2,20}){1,3}"
)
_GROUPED = re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![\w-])")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
# Word lists of the labelers.
_ASK = {
    "email": {"email", "mail", "e-mail", "correo", "courriel", "write", "contact", "kontakt", "contacto"},
    "ip": {"ip", "host", "server", "address", "from", "client", "login"},
    "card": {"card", "visa", "mastercard", "amex", "karte", "tarjeta", "carte", "credit", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "móvil", "handy", "whatsapp"},
    "account": {"iban", "account", "konto", "cuenta", "compte", "bank"},
}
_OTHER = {"version", "isbn", "issn", "section", "figure", "table", "page", "pp", "id", "no", "build", "chapter", "rfc", "usd", "eur", "total"}
_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu", "ch", "at", "it", "mx", "ar"}
_CALLING_CODES = {"1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "81", "86", "91"}
_LABELERS = 5
CONTEXT = 60  # characters before a candidate that the context labelers see


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            done = domain.end()
            yield first, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the four strict patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Looser candidates that overlap no base span and none before them, and the base spans."""
    out, marks = list(base), Marks(len(text), base)

    def take(span: Span) -> None:
        if marks.free(span):
            marks.add(span)
            out.append(span)

    lower = text.lower()
    if any(w in lower for w in ("dot", "punto", "punkt", "point")):
        for m in _SPELLED.finditer(text):
            take(("email", *m.span()))
    for m in _ACCOUNT.finditer(text):
        take(("account", *m.span()))
    for m in _GROUPED.finditer(text):
        kind = "card" if len(_digits(m[0])) >= 14 else "phone"
        if len(_digits(m[0])) >= 7:
            take((kind, *m.span()))
    return out


def _account_sum(text: str) -> bool:
    plain = text.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def votes(text: str, span: Span, strict: bool) -> tuple[int, ...]:
    """Votes of the labelers: 1 yes, -1 no, 0 abstains."""
    kind, a, b = span
    body, before = text[a:b], text[max(0, a - CONTEXT) : a]
    digits = _digits(body)
    words = re.findall(r"[\w-]+", before.lower())[-4:]
    pattern = 1 if strict else 0
    check = 0
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "account":
        check = 1 if _account_sum(body) else -1
    elif kind == "ip":
        check = -1 if body.startswith("0") else 1
    known = 0
    if kind == "email":
        known = 1 if re.split(r"[^a-z]+", body.lower())[-1] in _DOMAINS else -1
    elif kind == "phone":
        known = 1 if body.startswith("+") and any(digits.startswith(c) for c in _CALLING_CODES) else 0
    asked = 1 if any(w in _ASK[kind] for w in words) else 0
    other = -1 if any(w in _OTHER for w in words) or re.search(r"[$€#v]\s*$", before) else 0
    return pattern, check, known, asked, other


def shape(text: str, span: Span) -> tuple[int, ...]:
    """Coarse shape: letters or not, number of digits, separators, bracket or plus in front."""
    body = text[span[1] : span[2]]
    return (int(any(c.isalpha() for c in body)), min(len(_digits(body)) // 4, 5), min(sum(c in " .-" for c in body), 3), int(body[:1] in "(+"))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, kinds: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability that a vote pattern is personal data, by expectation-maximisation.

    Labelers err independently given the truth; what they do when they don't abstain is estimated per labeler, how
    common true candidates are per kind. One added yes and no per labeler keep estimates off 0 and 1; strict patterns
    start as trusted.
    """
    rows, labelers = patterns.shape
    p = np.where(patterns.sum(axis=1) > 0, 0.9, 0.2)
    for _ in range(rounds):
        prior = np.array([(np.sum((p * counts)[kinds == k]) + 1) / (np.sum(counts[kinds == k]) + 2) for k in kinds])
        log = np.log(prior) - np.log1p(-prior)
        for j in range(labelers):
            voted = patterns[:, j] != 0
            yes = patterns[:, j] > 0
            true, false = p * counts * voted, (1 - p) * counts * voted
            right = (true[yes].sum() + 3) / (true.sum() + 4)
            wrong = (false[yes].sum() + 1) / (false.sum() + 4)
            log += np.where(voted, np.where(yes, np.log(right / wrong), np.log((1 - right) / (1 - wrong))), 0.0)
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p


@dataclass
class SpanModel:
    weights: np.ndarray
    base: float

    def accepts(self, kind: str, vote: tuple[int, ...], form: tuple[int, ...]) -> bool:
        return float(_row(kind, vote, form) @ self.weights) + self.base > 0


def _row(kind: str, vote: tuple[int, ...], form: tuple[int, ...]) -> np.ndarray:
    return np.array([*(float(kind == k) for k in KINDS), *(float(v > 0) for v in vote), *(float(v < 0) for v in vote), *map(float, form)])


def fit_spans(docs: DataFrame, *, text: str = "text") -> SpanModel:
    """Classifier of candidates, from the counts of vote and shape patterns of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, tuple[int, ...], tuple[int, ...]]] = Counter()
        for _, texts in arrays.slices(batches, "body"):
            for raw in texts:
                body = raw.decode()
                base = base_spans(body)
                strict = set(base)
                found.update((s[0], votes(body, s, s in strict), shape(body, s)) for s in candidates(body, base))
        rows = [(k, list(v), list(f), n) for (k, v, f), n in found.items()]
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "votes", "shape", "n"])

    source = docs.select(F.col(text).cast("string").alias("body"))
    table = materialize(
        source.mapInArrow(count, "kind string, votes array<int>, shape array<int>, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")), "votes"
    )
    rows = sorted((r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["n"]) for r in table.collect())  # bounded by the labelers' answers and shapes
    width = len(KINDS) + 2 * _LABELERS + 4
    if not rows:
        return SpanModel(np.zeros(width), -1.0)
    n = np.array([r[3] for r in rows], dtype=float)
    p = reliabilities(np.array([r[1] for r in rows]), n, np.array([KINDS.index(r[0]) for r in rows]))
    x = np.column_stack([np.stack([_row(*r[:3]) for r in rows]), np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * min(n.sum(), 1e4)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * q * (1 - q))) @ x + np.eye(len(w)), x.T @ (weight * (p - q)) - w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return SpanModel(w[:-1], float(w[-1]))


def find_personal(docs: DataFrame, model: SpanModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts and digest, and all spans, of every row.

    Null counts as empty; texts without spans have an empty list. Repeated rows give repeated results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = sent.value.accepts
        for rows, texts in arrays.slices(batches, "body"):
            out: list[list] = [[] for _ in range(6)]
            for raw in texts:
                body = raw.decode()
                base = base_spans(body)
                spans = base + [s for s in candidates(body, base)[len(base) :] if accepts(s[0], votes(body, s, False), shape(body, s))]
                kinds = Counter(s[0] for s in base)
                for column, value in zip(out, (*(kinds[k] for k in BASE_KINDS), digest(base, KINDS), listed(spans, KINDS)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])], schema.names)

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return source.mapInArrow(scan, schema)
