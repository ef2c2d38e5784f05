"""Secrets in whole texts: three exact patterns, and a linear-chain conditional random field for the rest.

The base spans are those of the three patterns. The field tags each token as begin, inside or outside of a secret, from
its shape (length, classes of its characters, how often they change), the words beside it and their shapes, key words and
what separates it from them, and features of the whole text. It is trained here, by its likelihood, on generated lines
(TRAINING_LINES of them), and decoded by Viterbi. Its spans are added where they meet no base span; n_tagged is the number
of secrets that the field finds by itself, n_crf of those it adds. A scan is one pass over the documents without a shuffle.

Defined cases: a null or empty text has no spans; a null doc_id stays null; repeated rows are scanned as often as they
come; an empty table gives no rows; other columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weirlight.llm.common import joined, pieces, table, utf8, word_hashes

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HINTS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
KEYS = re.compile(rb"passw(?:or)?d|pwd|secret|token|api[_-]?key|auth|credential|private")
KEY_HINTS = (b"passw", b"pwd", b"secret", b"token", b"api", b"auth", b"credential", b"private")
TRAINING_LINES = 3000
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_tagged long, n_crf long"
OUT, BEGIN, INSIDE = 0, 1, 2
SIZES = {"shape": 768, "start": 10, "before": 12, "previous": 32, "next": 32, "changes": 8, "word": 256, "after": 256, "file": 8}
STARTS = (b"AKIA", b"ghp_", b"sk_l", b"sk-", b"xox", b"eyJ", b"AIza", b"MII", b"---")
CHUNK = 1 << 20

_DIGIT, _UPPER, _LOWER, _SIGN, _DOT, _OTHER = 1, 2, 4, 8, 16, 32
_CLASS = np.zeros(256, np.uint8)  # "=" belongs to a token only at its end
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = _OTHER if _c > 127 else _DIGIT if _s.isdigit() else _UPPER if _s.isupper() else _LOWER if _s.islower() else _SIGN if _s in "+/_-" else _DOT if _s == "." else 0
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def base_spans(text: str, has_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, each leftmost and non-overlapping within its kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if has_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


def features(buf: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Tokens of joined texts: begin, end, text number and the number of each feature. A token is a run of letters, digits, +/_-. and non-ASCII bytes, with up to two "=" that end it."""
    kind = _CLASS[buf]
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = kind != 0
    step = np.diff(inside)
    b, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    doc = np.searchsorted(starts, b, "right") - 1
    n = len(b)
    f = {k: np.zeros(n, np.int64) for k in SIZES}
    if not n:
        return b, e, doc, f
    digits, changes = np.zeros(len(buf) + 1, np.int32), np.zeros(len(buf) + 1, np.int32)
    np.cumsum(kind == _DIGIT, out=digits[1:])
    np.cumsum(np.r_[False, kind[1:] != kind[:-1]], out=changes[1:])
    has = np.bitwise_or.reduceat(kind, b)
    upper_all = (has & _UPPER > 0) & (has & _LOWER == 0)
    length = e - b
    share = (digits[e] - digits[b]) / length
    by_length = np.searchsorted([4, 8, 12, 16, 20, 32, 48], length, "right")
    by_share = np.where(share == 0, 0, np.where(share <= 0.2, 1, np.where(share <= 0.6, 2, 3)))
    upper = np.where(upper_all, 2, has & _UPPER > 0)
    sign = np.where(has & _OTHER > 0, 3, np.where(has & _SIGN > 0, 1, np.where(has & _DOT > 0, 2, 0)))
    f["shape"] = (((by_length * 4 + by_share) * 3 + upper) * 2 + (has & _LOWER > 0)) * 4 + sign
    turns = (changes[e] - changes[b + 1]) / length
    f["changes"] = np.where(length < 8, 0, 1 + np.searchsorted([0.001, 0.1, 0.2, 0.3, 0.45, 0.6], turns, "right"))
    coarse = by_length * 4 + by_share
    first, last = np.r_[True, doc[1:] != doc[:-1]], np.r_[doc[1:] != doc[:-1], True]
    f["previous"] = np.where(first, 0, np.r_[0, coarse[:-1]])
    f["next"] = np.where(last, 0, np.r_[coarse[1:], 0])
    words = 1 + (word_hashes(_LOW[buf], b, e) % np.uint64(255)).astype(np.int64)
    f["word"] = np.where(first, 0, np.r_[0, words[:-1]])
    f["after"] = np.where(last, 0, np.r_[words[1:], 0])
    for i in np.flatnonzero((length >= 8) & ((has & _DIGIT > 0) | (has & _UPPER > 0))):
        head = bytes(buf[b[i] : b[i] + 4])
        f["start"][i] = next((k for k, p in enumerate(STARTS, 1) if head.startswith(p)), 0)
    key = np.zeros(n, bool)
    for k, t in enumerate(texts):
        low = t.lower()
        if any(h in low for h in KEY_HINTS):
            at = [starts[k] + m.start() for m in KEYS.finditer(low)]
            key[np.searchsorted(b, at, "right") - 1] = True
    # what stands between a token and the one before it, where that is near
    gap = np.r_[0, b[1:] - e[:-1]]
    marks = []
    for chars in ((61,), (58, 64), (34, 39, 96)):
        total = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(np.isin(buf, chars), out=total[1:])
        marks.append((total[b] - total[np.r_[0, e[:-1]]] > 0) & (gap <= 6) & ~first)
    near = np.r_[False, key[:-1]] & ~first & (gap <= 6)
    f["before"] = (near * 3 + np.where(marks[0], 1, np.where(marks[1], 2, 0))) * 2 + marks[2]
    per = np.maximum(np.diff(starts), 1)
    dense = np.diff(digits[starts]) / per
    f["file"] = (np.searchsorted([0.005, 0.05, 0.2], dense, "right") + 4 * (per < 400))[doc]
    equal = np.r_[buf == 61, np.zeros(3, bool)]
    more = np.where(equal[e], 1 + equal[e + 1], 0)
    free = np.r_[kind, np.zeros(3, np.uint8)][e + more] == 0
    return b, e + np.where(free & ~equal[e + more], more, 0), doc, f


def emissions(model: dict[str, np.ndarray], f: dict[str, np.ndarray]) -> np.ndarray:
    """Score of each tag for each token."""
    return sum((model[k][f[k]] for k in SIZES), model["bias"])


def viterbi(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best tags of padded sequences (sequence, place, tag); outside precedes and follows each."""
    n, most, _ = scores.shape
    back = np.zeros((most, n, 3), np.int8)
    best = scores[:, 0] + transition[OUT]
    final = np.where((lengths == 1)[:, None], best, 0.0)
    for t in range(1, most):
        paths = best[:, :, None] + transition
        back[t] = paths.argmax(1)
        best = paths.max(1) + scores[:, t]
        final = np.where((lengths == t + 1)[:, None], best, final)
    tag = (final + transition[:, OUT]).argmax(1)
    tags = np.zeros((n, most), np.int8)
    rows = np.arange(n)
    for t in range(most - 1, -1, -1):
        here = t < lengths
        tags[here, t] = tag[here]
        if t:
            tag = np.where(here, back[t, rows, tag], tag)
    return tags


def decoded(scores: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Viterbi tags of sequences that lie one after the other; first marks where one starts.

    Where outside beats the other tags by more than all that two transitions can differ, the best path is outside, so
    the sequence falls apart there; only what lies between such tokens is worked through.
    """
    sure = scores[:, OUT] - scores[:, 1:].max(1) > 2 * (transition.max() - transition.min())
    tags = np.zeros(len(scores), np.int8)
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    starts = np.r_[True, (np.diff(open_) > 1) | first[open_[1:]]]
    begin = open_[starts]
    length = np.diff(np.r_[np.flatnonzero(starts), len(open_)])
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        top = max(8, 2 * length[order[at]])
        end = min(np.searchsorted(length[order], top, "right"), at + max(1, (1 << 20) // top))
        own = order[at:end]
        most = length[own].max()
        place = begin[own][:, None] + np.arange(most)
        valid = np.arange(most) < length[own][:, None]
        got = viterbi(scores[np.minimum(place, len(scores) - 1)], length[own], transition)
        tags[place[valid]] = got[valid]
        at = end
    return tags


def _lines(n: int, seed: int = 7) -> tuple[list[bytes], list[tuple[int, int] | None]]:
    """Generated lines, with the byte span of the secret in each that has one."""
    r = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    run = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    mixed, base64, hexes = lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", digits + "abcdef"
    keyed = [lambda: run(mixed, 12, 48), lambda: run(hexes, 16, 64), lambda: run(base64, 20, 64) + r.choice(["", "=", "=="]), lambda: run(mixed + "_-.", 12, 40), lambda: run(lower + digits, 12, 32)]
    bare = [
        lambda: run(hexes, 32, 64), lambda: run(hexes.upper(), 32, 64), lambda: run(mixed, 24, 48), lambda: run(base64, 32, 64) + r.choice(["", "=", "=="]), lambda: "AKIA" + run(lower.upper() + digits, 14, 16), lambda: "ghp_" + run(mixed, 30, 38), lambda: "sk_live_" + run(mixed, 20, 32), lambda: "sk-" + run(mixed, 24, 48),
        lambda: "xoxb-" + run(digits, 10, 12) + "-" + run(mixed, 20, 26), lambda: "eyJ" + run(mixed, 18, 40) + "." + run(mixed, 20, 60) + "." + run(mixed + "_-", 20, 44), lambda: "AIza" + run(mixed + "_-", 34, 36), lambda: "MII" + "\n".join(run(base64, 60, 64) for _ in range(r.randint(1, 4))),
    ]
    syllables = [run(lower + "éäöüñ", 1, 4) for _ in range(60)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    plain = [word] * 6 + [
        lambda: word().capitalize(), lambda: word().capitalize() + r.choice([".", ",", "!"]), lambda: run("éäöüñß" + lower, 4, 16).capitalize() + r.choice(["", ".", "!"]), lambda: word() + r.choice([".", ",", "!", ";", "%%%", "###", "***", "$$$"]), lambda: word().upper(), lambda: run(lower, 12, 40), lambda: run(digits, 1, 12), lambda: run(digits, 13, 19), lambda: " ".join(run(digits, 4, 4) for _ in range(4)), lambda: "-".join(run(digits, 4, 4) for _ in range(4)),
        lambda: ".".join(run(digits, 1, 3) for _ in range(4)), lambda: f"+{run(digits, 1, 2)} ({run(digits, 3, 3)}) {run(digits, 3, 3)}-{run(digits, 4, 4)}", lambda: f"{word()}@{word()}.com", lambda: f"{word()}.{word()}{run(digits, 1, 3)}@{word()}.org", lambda: f"https://{word()}.org/{word()}/{run(digits, 1, 9)}?id={run(mixed, 3, 8)}",
        lambda: f"20{run(digits, 2, 2)}-{run(digits, 2, 2)}-{run(digits, 2, 2)}T{run(digits, 2, 2)}:00:00", lambda: f"{word()}_{word()}", lambda: word() + run(digits, 1, 3), lambda: f"{word()}-{word()}-{word()}", lambda: word().capitalize() + word().capitalize() + word().capitalize(), lambda: "_".join(word().upper() for _ in range(3)), lambda: "-".join(run(hexes, k, k) for k in (8, 4, 4, 4, 12)),
        lambda: r.choice(["password", "secret", "token", "the token", "auth", "private", "api"]), lambda: r.choice(["password", "secret", "token"]) + r.choice([": ", " = ", " is "]) + word(), lambda: f"/{word()}/{word()}/{word()}.py", lambda: f"v{run(digits, 1, 2)}.{run(digits, 1, 2)}.{run(digits, 1, 3)}", lambda: "#" + run(hexes, 6, 6), lambda: run(hexes, 7, 10), lambda: f"{word()}({word()}, {run(digits, 1, 4)})",
    ]
    keys = ["password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "client_secret", "private_key", "credential", "PWD", "pwd", "Authorization: Bearer", "auth", "access_token", "SECRET_KEY"]
    texts, spans = [], []
    for _ in range(n):
        words = [r.choice(plain)() for _ in range(r.randint(3, 18))]
        if r.random() < 0.4:
            named = r.random() < 0.6
            secret = r.choice(keyed + bare if named else bare)()
            quote = r.choice(["", '"', "'"])
            head = r.choice(keys) + r.choice([" = ", ": ", "=", ":", " : ", '": ', " => ", " "]) if named else r.choice(["", "", "-----BEGIN PRIVATE KEY-----\n"] if secret.startswith("MII") else [""])
            k = r.randint(0, len(words))
            left = " ".join(words[:k]) + r.choice([" ", "\n"]) * bool(k) + head + quote
            texts.append(f"{left}{secret}{quote} {' '.join(words[k:])}".encode())
            spans.append((len(left.encode()), len(left.encode()) + len(secret)))
        else:
            texts.append(" ".join(words).encode())
            spans.append(None)
    return texts, spans


@cache
def trained(lines: int = TRAINING_LINES, rounds: int = 70) -> dict[str, np.ndarray]:
    """Weights that maximise the penalised likelihood of the generated lines, by Adam."""
    texts, spans = _lines(lines)
    buf, starts = joined(texts)
    b, e, doc, f = features(buf, starts, texts)
    gold = np.zeros(len(b), np.int64)
    for k, s in enumerate(spans):
        if s:
            hit = np.flatnonzero((doc == k) & (b < starts[k] + s[1]) & (e > starts[k] + s[0]))
            gold[hit] = INSIDE
            gold[hit[:1]] = BEGIN
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[first, len(b)])
    most = length.max()
    place = np.minimum(first[:, None] + np.arange(most), len(b) - 1)
    valid = np.arange(most) < length[:, None]
    y = np.where(valid, gold[place], OUT)
    model = {k: np.zeros((n, 3)) for k, n in SIZES.items()} | {"bias": np.zeros(3), "transition": np.zeros((3, 3))}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    empirical = np.zeros((3, 3))
    path = np.concatenate([np.zeros((len(y), 1), int), y, np.zeros((len(y), 1), int)], 1)
    step_valid = np.concatenate([valid, np.ones((len(y), 1), bool)], 1)
    step_valid[:, 1:-1] = valid[:, 1:]
    np.add.at(empirical, (path[:, :-1][:, :most][valid], path[:, 1:][:, :most][valid]), 1)
    np.add.at(empirical, (y[np.arange(len(y)), length - 1], 0), 1)
    for r in range(1, rounds + 1):
        psi = np.exp(np.clip(emissions(model, f)[place], -30, 30))
        psi = np.where(valid[:, :, None], psi, 1.0)
        trans = np.exp(model["transition"])
        alpha, beta = np.zeros_like(psi), np.ones_like(psi)
        a = trans[OUT] * psi[:, 0]
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, most):
            a = (alpha[:, t - 1] @ trans) * psi[:, t]
            a /= a.sum(1, keepdims=True)
            alpha[:, t] = np.where(valid[:, t, None], a, alpha[:, t - 1])
        tail = trans[:, OUT]
        beta[:, most - 1] = tail
        for t in range(most - 2, -1, -1):
            x = (beta[:, t + 1] * psi[:, t + 1]) @ trans.T
            beta[:, t] = np.where(valid[:, t + 1, None], x / x.sum(1, keepdims=True), tail)
        prob = alpha * beta
        prob /= prob.sum(2, keepdims=True)
        expected = np.zeros((3, 3))
        pair = alpha[:, :-1, :, None] * trans * (psi * beta)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        expected += pair[valid[:, 1:]].sum(0)
        expected[OUT] += prob[:, 0].sum(0)
        expected[:, OUT] += prob[np.arange(len(y)), length - 1].sum(0)
        flat = np.zeros((len(b), 3))
        flat[place[valid]] = prob[valid]
        delta = np.eye(3)[gold] - flat
        grad = {k: np.stack([np.bincount(f[k], delta[:, c], n) for c in range(3)], 1) for k, n in SIZES.items()} | {"bias": delta.sum(0), "transition": empirical - expected}
        for k in model:
            g = grad[k] / len(y) - 1e-4 * model[k]
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model[k] += 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    np.clip(model["transition"], -3, 3, out=model["transition"])
    return model


def tagged(buf: np.ndarray, starts: np.ndarray, texts: list[bytes], model: dict[str, np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """What the field by itself takes for secrets: spans of bytes of each text that has any."""
    b, e, doc, f = features(buf, starts, texts)
    first = np.r_[True, doc[1:] != doc[:-1]][: len(b)]
    tags = decoded(emissions(model, f), first, model["transition"])
    heads = np.flatnonzero((tags == BEGIN) | ((tags == INSIDE) & (first | (np.r_[0, tags[:-1]][: len(b)] == OUT))))
    out: dict[int, list[tuple[int, int]]] = {}
    for i in heads.tolist():
        j = i + 1
        while j < len(tags) and tags[j] == INSIDE and doc[j] == doc[i]:
            j += 1
        k = int(doc[i])
        out.setdefault(k, []).append((int(b[i] - starts[k]), int(e[j - 1] - starts[k])))
    return out


def found(texts: list[bytes], model: dict[str, np.ndarray]) -> list[tuple[list[tuple[int, int, int]], int]]:
    """Of each text all spans, (start, kind, end) in code points, sorted, and how many secrets the field finds by itself."""
    buf, starts = joined(texts)
    hexes = (_CLASS[buf] == _DIGIT) | ((buf >= 97) & (buf <= 102))
    run = np.diff(np.r_[0, hexes.astype(np.int8), 0])
    hb, he = np.flatnonzero(run == 1), np.flatnonzero(run == -1)
    with_hex = set((np.searchsorted(starts, hb[he - hb >= 16], "right") - 1).tolist())
    added = tagged(buf, starts, texts, model)
    out: list[tuple[list[tuple[int, int, int]], int]] = []
    for k, t in enumerate(texts):
        low = t.lower()
        spans: list[tuple[int, int, int]] = []
        if k in with_hex or b"AKIA" in t or any(h in low for h in HINTS):
            spans = base_spans(t.decode("utf-8", "replace"), k in with_hex)
        if k in added:
            point = np.zeros(len(t) + 1, np.int64)
            np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80, out=point[1:])
            for x, y in added[k]:
                x, y = int(point[x]), int(point[y])
                if not any(s < y and x < z for s, kind, z in spans if kind < 3):
                    spans.append((x, 3, y))
            spans.sort()
        out.append((spans, len(added.get(k, ()))))
    return out


def _scanner(model: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def text_of(spans: list[tuple[int, int, int]]) -> str:
        return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [utf8(t) for t in batch.column(1).to_pylist()]
            got = [x for b, e in pieces(texts, CHUNK) for x in found(texts[b:e], model)]
            spans = [x for x, _ in got]
            count = lambda k: pa.array([sum(s[1] == k for s in x) for x in spans], pa.int64())
            base = [hashlib.sha256(text_of([s for s in x if s[1] < 3]).encode()).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array([text_of(x) for x in spans], pa.string()), pa.array([n for _, n in got], pa.int64()), count(3)], names=[x.split()[0] for x in SCHEMA.split(", ")]
            )

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_tagged, n_crf."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(_scanner(trained()), SCHEMA)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
