"""Personal data and secrets: fixed patterns, and weakly supervised spans.

Base spans (email, ip, card, phone) come from fixed patterns with checks and are always
kept. Further spans (kind ``secret``: keys, tokens, passwords, account numbers) are found so:

1. Candidates are unbroken runs of 11 or more key characters that hold a digit or a known
   prefix, numbers written like identity, account (also in groups of four) or national phone
   numbers, and whatever an announcing word and an assignment sign stand before, in quotes
   or up to the next white space.
2. Labelers vote on each candidate: regex (hexadecimal, mixed letters and digits, upper-case
   key, account number with its checksum), gazetteer (known key prefixes), context (a word
   such as "password" before it, an assignment sign, quotes), and shape (changes between
   letters and digits, plain words, a word in the middle of a sentence). What is announced and
   assigned, or has the shape of a known number, may be short and even: there the shape
   labelers don't speak against it, unless the sentence goes on behind it ("secret: nobody
   knows"): there the context labelers say nothing.
3. Votes of the whole corpus are reduced to counts of vote patterns;
   expectation-maximisation estimates how each labeler votes on true and false candidates,
   from a prior that says which side it speaks for.
4. A logistic classifier on votes and shape is trained on the posteriors, pattern by
   pattern, so on all candidates; a span is kept at probability 0.5 or more.

Patterns are anchored at ``@``, ``+`` and digits and never look back twice, so long texts
take linear time.

Cases: null and empty texts have no spans; without any candidate the prior decides; repeated
rows are treated alike; an empty table gives an empty result; other columns are ignored.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.textio import values

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
Span = tuple[int, int, int]  # kind number, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{11,}")
_NUMBER = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_SURE = r"(?:1[-. ])?(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}|\(0[0-9]{1,4}\) ?[0-9]{3,8}(?:[ -][0-9]{2,4}){0,2}|0[0-9]{2,4}[ /-][0-9]{6,8}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -][0-9]{3,4}"
_PHONE_SURE = re.compile(rf"(?:{_SURE})(?![0-9A-Za-z-])")
_NATIONAL = re.compile(rf"(?<![0-9A-Za-z.+-])(?:{_SURE}|[0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{4}}|[0-9]{{3}}-[0-9]{{4}})(?![0-9A-Za-z-])")
_SIGN = re.compile(r"=>|[:=]")
_VALUE = re.compile(r"[ \t]{0,2}(?:\"([^\"\n]+)\"|'([^'\n]+)'|((?:(?!&\w+=)[^\s\"'<>])+))")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UPPER = re.compile(r"[A-Z0-9]{16,}\Z")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
_CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_PLAIN = re.compile(r"[a-z]{6,}")
_NEXT_WORD = re.compile(r"[,;]?[ \t]+[^\W\d_]")
#: Words that announce a secret, and prefixes of known key formats.
_ANNOUNCE = re.compile(r"(?:token|passw(?:or)?d|pwd|secret|api[ _-]?key|access[ _-]?key|auth|bearer|credential|iban|account|ssn|pass(?:phrase|code)|(?:secret|private)[ _-]?key|phone|mobile|\btel|\bfax|\bcell|\bpin)\W{0,8}\Z", re.I)
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "ya29")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns by kind, then start."""
    text = text or ""
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _checks(account: str) -> bool:
    return bool(_ACCOUNT.match(account)) and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _grouped(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers in groups of four: up to the last group that makes the checksum right, else all."""
    for m in _IBAN.finditer(text):
        ends = [m.start() + i for i, c in enumerate(m[0]) if c in " -"] + [m.end()]
        fits = [e for e in ends if _checks(_compact(text[m.start() : e]))]
        yield m.start(), max(fits, default=m.end())


def _compact(run: str) -> str:
    return run.replace(" ", "").replace("-", "")


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """What stands behind an announcing word and an assignment sign; signs inside it start nothing."""
    done = 0
    for m in _SIGN.finditer(text):
        if m.start() >= done and _ANNOUNCE.search(text[max(0, m.start() - 20) : m.start()]) and (v := _VALUE.match(text, m.end())):
            k = v.lastindex
            a, b = v.span(k)
            done = b
            if k == 3:  # without quotes: no punctuation of the sentence
                b = a + len(v[k].rstrip(".,;:?)]}"))
            if a < b:
                yield a, b


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans that could be secrets: runs with a digit or behind a known prefix, known shapes of numbers, assigned values."""
    text = text or ""
    out = {m.span() for m in _RUN.finditer(text) if _DIGIT.search(m[0]) or m[0].startswith(PREFIXES)}
    if _DIGIT.search(text):
        taken = {a for a, _ in out}
        out.update(m.span() for m in _NUMBER.finditer(text) if m.start() not in taken)
        out.update(_grouped(text))
        out.update(m.span() for m in _NATIONAL.finditer(text))
    out.update(_assigned(text))
    return sorted(out, key=lambda s: (s[0], -s[1]))


#: What each labeler says: (name, side it speaks for).
LABELERS = ("hex", "mixed", "upper", "account", "prefix", "announced", "assigned", "quoted", "changes", "digits_only", "plain", "short", "prose")


def votes(text: str, start: int, end: int) -> tuple[int, ...]:
    """Votes in the order of ``LABELERS``: 1 secret, 0 not, 2 nothing."""
    run, before = text[start:end], text[max(0, start - 24) : start]
    grouped = bool(_IBAN.fullmatch(run)) and _checks(_compact(run))
    run = _compact(run) if grouped else run
    digits = sum(c.isdigit() for c in run)
    letters = sum(c.isalpha() for c in run)
    changes = len(_CHANGE.findall(run))
    number = grouped or _checks(run) or bool(_NUMBER.match(text, start)) or bool(_PHONE_SURE.fullmatch(run))
    announced = bool(_ANNOUNCE.search(before))
    assigned = before.rstrip("\"' \t").endswith(("=", ":", "=>"))
    # a word of a sentence: small letters alone, a blank before it and another word behind
    prose = run.isalpha() and run.islower() and before.endswith((" ", "\t")) and bool(_NEXT_WORD.match(text, end))
    free = number or (announced and assigned and not prose)
    return (
        1 if len(run) >= 16 and digits and letters and _HEX.match(run) else 2,
        1 if len(run) >= 20 and digits >= 3 and any(c.islower() for c in run) and any(c.isupper() for c in run) and not _PLAIN.search(run) else 2,
        1 if digits and letters and _UPPER.match(run) else 2,
        1 if number else 2,
        1 if run.startswith(PREFIXES) else 2,
        1 if announced and not prose else 2,
        2 if prose else 1 if assigned else 0 if before.endswith((".", ",")) else 2,
        1 if before.endswith(('"', "'")) and text[end : end + 1] == before[-1] else 2,
        1 if changes >= 4 else 0 if changes <= 1 and not free else 2,
        0 if not letters and not free else 2,
        0 if _PLAIN.search(run) else 2,
        0 if len(run) < (4 if free else 14) else 2,
        0 if prose else 2,
    )


def _table(says: dict[int, float], strength: float) -> np.ndarray:
    return strength * np.array([says[0], says[1], says[2]])


def fit_reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray]:
    """EM over counted vote patterns: share of true candidates and P(vote | class) per labeler.

    The prior (a tenth of the candidates, five at least) says that labelers speak rarely
    for the wrong side; it keeps the classes apart where a corpus has only one of them.
    """
    strength = max(5.0, 0.1 * counts.sum())
    prior = np.array([
        [_table({0: 0.45, 1: 0.03, 2: 0.52}, strength), _table({0: 0.08, 1: 0.4, 2: 0.52}, strength)] for _ in range(patterns.shape[1])
    ])
    table = prior / prior.sum(axis=2, keepdims=True)
    share = 0.5
    for _ in range(rounds):
        post = posterior(patterns, share, table)
        old = table
        share = float((counts @ post + 0.5 * strength) / (counts.sum() + strength)) if counts.sum() else 0.5
        table = prior.copy()
        for j in range(patterns.shape[1]):
            for y, p in enumerate((1 - post, post)):
                table[j, y] += np.bincount(patterns[:, j], weights=p * counts, minlength=3)
        table /= table.sum(axis=2, keepdims=True)
        if np.abs(table - old).max() < 1e-6:
            break
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    score = np.full(len(patterns), np.log(share / (1 - share)))
    for j in range(patterns.shape[1]):
        score += (np.log(table[j, 1]) - np.log(table[j, 0]))[patterns[:, j]]
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _inputs(patterns: np.ndarray) -> np.ndarray:
    """Classifier inputs: which labelers speak for and against, and how many."""
    yes, no = (patterns == 1).astype(float), (patterns == 0).astype(float)
    return np.column_stack([np.ones(len(patterns)), yes, no, np.minimum(yes.sum(1), 3), np.minimum(no.sum(1), 3)])


@dataclass(frozen=True)
class Model:
    share: float
    table: np.ndarray
    weights: np.ndarray

    def keeps(self, pattern: tuple[int, ...]) -> bool:
        return bool((_inputs(np.array([pattern])) @ self.weights)[0] >= 0)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Reliabilities and span classifier from the vote patterns of all candidates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in values(batch.column(0)):
                if t:
                    seen.update("".join(map(str, votes(t, a, b))) for a, b in candidates(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    tally = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "pattern string, n long")
    rows = tally.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # bounded by the labelers' patterns
    patterns = np.array([[int(c) for c in r["pattern"]] for r in rows], dtype=np.int64).reshape(len(rows), len(LABELERS))
    counts = np.array([r["n"] for r in rows], float)
    share, table = fit_reliabilities(patterns, counts)
    # single votes join the training set, each with the weight of one candidate, so every vote has a weight
    single = np.full((2 * len(LABELERS), len(LABELERS)), 2)
    for j in range(len(LABELERS)):
        single[2 * j, j], single[2 * j + 1, j] = 1, 0
    every = np.concatenate([patterns, single])
    weight = np.concatenate([_scaled(counts), np.ones(len(single))])
    return Model(share, table, _fit_linear(_inputs(every), posterior(every, share, table), weight))


def _scaled(counts: np.ndarray, most: float = 10_000) -> np.ndarray:
    """Counts by one factor, so that they sum to ``most`` at most: patterns weigh alike in corpora of any size."""
    return counts * min(1.0, most / max(counts.sum(), 1.0))


def _fit_linear(x: np.ndarray, y: np.ndarray, k: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (k * (y - p)) - ridge * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def all_spans(text: str | None, model: Model, known: dict[tuple[int, ...], bool]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind, then start. A candidate inside a base span or a kept one adds nothing."""
    base = base_spans(text)
    more: list[Span] = []
    for a, b in candidates(text):
        if any(s <= a and b <= e for _, s, e in base) or (more and b <= more[-1][2]):
            continue
        pattern = votes(text, a, b)
        if pattern not in known:
            known[pattern] = model.keeps(pattern)
        if known[pattern]:
            more.append((len(BASE), a, b))
    return base, base + more


def _join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(text: Column | str, model: Model) -> Column:
    """Struct of n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    @F.arrow_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(v: pa.Array) -> pa.Array:
        known: dict[tuple[int, ...], bool] = {}
        counts: list[list[int]] = [[], [], [], []]
        digests, spans = [], []
        for t in v:
            base, every = all_spans(t.as_py(), model, known)
            for k in range(4):
                counts[k].append(sum(s[0] == k for s in base))
            digests.append(sha256(_join(base).encode()).hexdigest())
            spans.append(_join(every))
        cols = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.StructArray.from_arrays(cols, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run(text)


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with sorted (start, end, kind) spans replaced; overlapping ones become one."""
    parts, done, i = [], 0, 0
    while i < len(spans):
        a, b, k = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        parts += [text[done:a], f"<{KINDS[k].upper()}>"]
        done, i = b, i + 1
    return "".join([*parts, text[done:]])


def mask(text: Column | str, model: Model) -> Column:
    """The text with every span replaced by its kind, as ``<EMAIL>``; overlapping spans become one. Null stays null."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        known: dict[tuple[int, ...], bool] = {}
        changed, texts = [], []
        for x in v:
            t = x.as_py()
            spans = sorted((a, b, k) for k, a, b in all_spans(t, model, known)[1])
            changed.append(bool(spans))
            if spans:
                texts.append(_masked(t, spans))
        # only changed texts are built anew
        return pc.replace_with_mask(v, pa.array(changed, pa.bool_()), pa.array(texts, v.type)) if texts else v

    return run(text)
