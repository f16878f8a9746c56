"""Personal data by weak supervision (operator 4).

Four base patterns always count: e-mail and IP addresses, card numbers and phone numbers, leftmost and not
overlapping within a kind. Looser patterns propose further spans of these kinds and of three more (ssn,
iban, secret). Five labelers vote on every span for, against, or not at all:

    shape      the strict form of the kind, or one that only looks like it
    checksum   Luhn, IBAN remainder, ranges of octets and groups, variety of a secret's characters
    gazetteer  calling codes, card issuers, top-level domains, reserved address blocks, key words of secrets
    context    words before the span that announce the kind, or something else
    isolation  standing alone, or inside a longer run of letters and digits, or of one digit repeated

Expectation-maximisation over the corpus' counts of vote patterns estimates how often each labeler votes
which way on true and on false spans, and a share of true spans for each kind. Its posteriors, weighted by
counts, train the span classifier: a logistic regression on kind, votes, length and share of digits, which
decides about the proposed spans. Only counts of patterns (a fixed number of combinations) reach the driver.

The text is read once; spans and patterns are written, and the verdict is a lookup by pattern. Proposed
spans that overlap a base span go. Offsets are code points. Null text is empty; empty tables, repeated rows
and other columns are no special cases.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import slices, table, tidy, written

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("shape", "checksum", "gazetteer", "context", "isolation")
ACCEPT = 0.5
ROUNDS = 50
RESULT = "base array<struct<start:long,kind:int,end:long>>, more array<struct<start:long,kind:int,end:long,pattern:string>>, votes array<string>"

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from all, so a match may only begin there.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
SPELLED_AT = re.compile(r"[(\[](?:at|AT)[)\]]")

# What proposes further spans, by kind.
LOOSE = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,63})+")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ .-]|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{2,4}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
)

# Gazetteers and context words: fixed lists.
TOP_DOMAINS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au in jp br ru ch at be".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
RESERVED = ("0.", "127.", "255.")
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "CH": 21, "AT": 20, "BE": 16}
SECRET_WORDS = re.compile(r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private.?key)[^\n]{0,12}$")
CUES = {
    "email": re.compile(r"(?i)mail|contact|write|reach|correo|courriel|schreib"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|adresse|direcci|network|login"),
    "card": re.compile(r"(?i)card|visa|credit|payment|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|call|tel\b|fax|mobile|whatsapp|anruf|appel|llam"),
    "ssn": re.compile(r"(?i)ssn|social security|tax"),
    "iban": re.compile(r"(?i)iban|bank|account|konto|compte|cuenta"),
    "secret": SECRET_WORDS,
}
OTHER = re.compile(r"(?i)(?:version|release|isbn|issn|doi|order|invoice|serial|model|page|chapter|section|commit|checksum|sha\d*|md5|hash)\W{0,4}$")


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start and kind."""
    out, last = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            last = m.end()
    if not DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def votes(kind: str, text: str, start: int, end: int, strict: bool) -> str:
    """One sign per labeler: + for, - against, 0 none."""
    x, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 2]
    d, letters = digits_of(x), sum(c.isalpha() for c in x)
    shape = "+" if strict or kind in ("ssn", "iban") else "0"
    checksum = gazetteer = "0"
    if kind == "email":
        gazetteer = "+" if re.split(r"[.\s)\]]+", x.lower())[-1] in TOP_DOMAINS else "0"
        checksum = "+" if ".." not in x and len(x) <= 254 else "-"
    elif kind == "ip":
        gazetteer = "-" if x.startswith(RESERVED) else "0"
        checksum = "+" if ":" in x or octets(x) else "-"
    elif kind == "card":
        gazetteer = "+" if d.startswith(ISSUERS) else "-"
        checksum = "+" if 14 <= len(d) <= 19 and luhn(d) else "-"
    elif kind == "phone":
        gazetteer = "+" if d.removeprefix("00").startswith(CALLING) and x[0] in "+0" else "0"
        checksum = "+" if 10 <= len(d) <= 15 else "-"
    elif kind == "ssn":
        checksum = "-" if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else "+"
    elif kind == "iban":
        plain = x.replace(" ", "")
        gazetteer = "0" if plain[:2] not in IBAN_LENGTHS else "+" if IBAN_LENGTHS[plain[:2]] == len(plain) else "-"
        checksum = "+" if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else "-"
    else:
        shape = "+" if d and letters else "-"
        gazetteer = "+" if SECRET_WORDS.search(before) else "0"
        checksum = "+" if len(set(x)) >= 10 and 5 * len(d) >= len(x) else "-"
    context = "-" if OTHER.search(before) else "+" if CUES[kind].search(before) else "0"
    joined = (before[-1:].isalnum() or before[-1:] == "_") or (after[:1].isalnum() or after[:1] == "_")
    one = len(set(d)) == 1 if len(d) >= 6 else False
    isolation = "-" if joined or one else "+"
    return shape + checksum + gazetteer + context + isolation


def pattern(kind: str, signs: str, x: str) -> str:
    """Kind, votes, length class and share of digits: what the classifier sees of a span."""
    return f"{kind}|{signs}|{min(len(x) // 8, 6)}|{3 * len(digits_of(x)) // max(len(x), 1)}"


def proposed(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """Further spans that overlap no base span and no earlier kind's span."""
    taken, out = sorted((s, e) for s, _, e in base), []
    for kind, loose in LOOSE:
        if kind == "email" and not SPELLED_AT.search(text) or kind != "email" and not DIGIT.search(text):
            continue
        found = [m.span() for m in loose.finditer(text)]
        if kind == "secret":
            found = [(s, e) for s, e in found if DIGIT.search(text, s, e)]
        # Ends of what begins before a place, so that one look-up finds an overlap.
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        free = [(s, e) for s, e in found if not ((k := bisect_left(starts, e)) and reach[k - 1] > s)]
        taken = sorted(taken + free)
        out += [(s, KINDS.index(kind), e, pattern(kind, votes(kind, text, s, e, False), text[s:e])) for s, e in free]
    return sorted(out)


def scan_column(text: Column) -> Column:
    """Struct column with the fields of RESULT; ``votes`` holds the patterns of the base spans."""
    span = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
    kind_of = pa.struct([
        ("base", pa.list_(pa.struct(span))), ("more", pa.list_(pa.struct([*span, ("pattern", pa.string())]))),
        ("votes", pa.list_(pa.string())),
    ])

    def scan(t: bytes | None) -> dict:
        x = t.decode() if t else ""
        base = base_spans(x)
        more = proposed(x, base)
        return {
            "base": [{"start": s, "kind": k, "end": e} for s, k, e in base],
            "more": [{"start": s, "kind": k, "end": e, "pattern": p} for s, k, e, p in more],
            "votes": [pattern(KINDS[k], votes(KINDS[k], x, s, e, True), x[s:e]) for s, k, e in base],
        }

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([scan(t) for part in slices(texts) for t in part], kind_of)

    return F.arrow_udf(tidy(run), RESULT).asNondeterministic()(text.cast("string"))


class Reliability:
    """What expectation-maximisation finds: of each labeler the odds of its votes, of each kind the share of true spans."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        keys = sorted(counts)
        n = np.array([counts[k] for k in keys], float)
        kind = np.array([KINDS.index(k) for k, _ in keys], int)
        vote = np.array([["-0+".index(c) for c in s] for _, s in keys], int).reshape(len(keys), len(LABELERS))
        # At first the majority is believed.
        p = 1 / (1 + np.exp(-(vote - 1).sum(axis=1).astype(float)))
        for _ in range(ROUNDS):
            true, false = n * p, n * (1 - p)
            self.share = np.array([(true[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
            self.odds = np.zeros((2, len(LABELERS), 3))
            for j in range(len(LABELERS)):
                for y, w in enumerate((false, true)):
                    c = np.bincount(vote[:, j], weights=w, minlength=3) + 1.0
                    self.odds[y, j] = c / c.sum()
            p = self.posterior(kind, vote)
        self.keys, self.n, self.kind, self.vote, self.p = keys, n, kind, vote, p

    def posterior(self, kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
        logs = [np.log(self.odds[y][np.arange(len(LABELERS)), vote]).sum(axis=1) for y in (0, 1)]
        z = logs[1] - logs[0] + np.log(self.share[kind]) - np.log1p(-self.share[kind])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def describe(pattern: str) -> np.ndarray:
    """The classifier's features of a pattern: ones for kind, votes, length class and digit class, and a constant."""
    kind, signs, length, digits = pattern.split("|")
    x = np.zeros(len(KINDS) + 3 * len(LABELERS) + 7 + 4 + 1)
    x[KINDS.index(kind)] = 1
    for j, c in enumerate(signs):
        x[len(KINDS) + 3 * j + "-0+".index(c)] = 1
    x[len(KINDS) + 3 * len(LABELERS) + int(length)] = 1
    x[len(KINDS) + 3 * len(LABELERS) + 7 + int(digits)] = 1
    x[-1] = 1
    return x


def classify(patterns: dict[str, int]) -> dict[str, float]:
    """Probability that a span is personal data, by pattern; learned from the patterns' counts."""
    if not patterns:
        return {}
    votes_of: dict[tuple[str, str], int] = {}
    for p, n in patterns.items():
        kind, signs = p.split("|")[:2]
        votes_of[kind, signs] = votes_of.get((kind, signs), 0) + n
    em = Reliability(votes_of)
    posterior = dict(zip(em.keys, em.p))
    names = sorted(patterns)
    x = np.stack([describe(p) for p in names])
    y = np.array([posterior[tuple(p.split("|")[:2])] for p in names])
    n = np.array([patterns[p] for p in names], float)
    weight = np.log1p(n) / np.log1p(n).sum()  # rare patterns are heard too
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - y)) + 1e-4 * w
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return dict(zip(names, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))))


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of start, kind number, end, in order)."""
    found = written(docs.select(F.col(id).alias("doc_id"), scan_column(F.col(text)).alias("f")).select("doc_id", "f.*"))
    # Kinds, votes and classes make a fixed number of patterns, whatever the input.
    all_patterns = F.explode(F.concat("votes", F.transform("more", lambda m: m["pattern"])))
    counts = {r["p"]: r["count"] for r in found.select(all_patterns.alias("p")).groupBy("p").count().collect()}
    good = sorted(p for p, q in classify(counts).items() if q >= accept)
    known = F.array(*[F.lit(p) for p in good]).cast("array<string>")
    kept = F.filter("more", lambda m: F.array_contains(known, m["pattern"]))
    plain = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def as_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list) -> str:
    """The text with each span replaced by its kind."""
    out, last = [], 0
    for s in spans:
        start, kind, end = s["start"], s["kind"], s["end"]
        if start >= last:
            out += [text[last:start], f"<{KINDS[kind]}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    of = [count(kind) for kind in range(len(BASE_KINDS))]
    return found.select("doc_id", *of, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
