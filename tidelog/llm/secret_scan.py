"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field that tags tokens and adds what it finds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD_SLICE_BYTES, slices, sums

# The base patterns, and how long a match (for assign: its value) must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "crf"]
# A text without any of these, or without a run of hex digits, is not searched.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_RUNS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

# Tokens: an equals sign or a colon, or a run of other characters than these marks and ASCII spaces.
_MARKS = "\"'`,;()<>[]{}|"
TOKEN = re.compile(r"[=:]|[^\s=:\"'`,;()<>\[\]{}|]+", re.A)
_SPACED = bytes(32 if chr(b) in _MARKS or chr(b) in "\t\n\x0b\x0c\r" else b for b in range(256))

# Rows the field is fitted to at most: windows of tokens from a sample of about so many documents.
TRAINING_ROWS, TRAINING_WINDOWS, WINDOWS_A_ROW, REACH = 3000, 3000, 4, 12
EPOCHS, RATE, PENALTY = 60, 0.1, 1e-4
# Tags: outside, begin, inside.
TAGS = 3
NEIGHBOURS = (-2, -1, 0, 1, 2)

# Words that go before secrets (fixed values); a token that ends in one counts.
BEFORE = ("password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "key", "apikey", "auth", "bearer", "credential", "credentials", "authorization")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the base patterns in order; places count code points, the end is exclusive."""
    found, raw = [], text.encode()
    low = raw.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in raw.translate(_RUNS):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- features ----------------------------------------------------------------

# Classes of bytes: small letter, capital, digit, joining mark, other ASCII, beyond ASCII.
_CLASS = np.array([5 if b >= 128 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 if chr(b) in "+/_.-" else 4 for b in range(256)])
_IS_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_LENGTHS = np.array([2, 3, 4, 6, 9, 12, 16, 20, 25, 32, 41, 65])
# Values of each feature of a token; a token has one value of each.
SHAPE = {"length": 13, "classes": 64, "digits": 6, "changes": 6, "hex": 2, "start": 216, "before": 2, "mark": 3}
FILE = {"marks": 5, "digits": 5}
_OFFSETS = np.cumsum([0, *SHAPE.values()])
N_SHAPE, N_FILE = int(_OFFSETS[-1]), sum(FILE.values())


def shapes(tokens: pa.StringArray) -> np.ndarray:
    """A row of feature numbers (one of each of ``SHAPE``) per token; tokens are not empty."""
    binary = tokens.cast(pa.binary())
    ends = np.frombuffer(binary.buffers()[1], np.int32, len(binary) + 1 + binary.offset)[binary.offset :].astype(np.int64)
    data = np.frombuffer(binary.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    starts, size = ends[:-1], np.diff(ends)
    kind = _CLASS[data]
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), starts)
    classes = np.bitwise_or.reduceat(1 << kind, starts)
    changed = np.concatenate(([True], kind[1:] != kind[:-1]))
    changed[starts] = True
    changes = total(changed)
    # The first three classes of a token, repeats left out.
    run = np.cumsum(changed) - 1
    kinds = np.append(kind[changed], [0, 0, 0])
    first = run[starts]
    opening = sum(np.where(changes > i, kinds[first + i], 5 if i else 0) * 6 ** (2 - i) for i in range(3))
    digits = total(kind == 2)
    low = pc.ascii_lower(tokens)
    before = np.zeros(len(tokens), bool)
    for word in BEFORE:
        before |= pc.ends_with(low, word).to_numpy(zero_copy_only=False)
    single = size == 1
    mark = np.where(single & (data[starts] == ord("=")), 1, np.where(single & (data[starts] == ord(":")), 2, 0))
    columns = [
        np.searchsorted(_LENGTHS, size, side="right"), classes, np.where(digits == 0, 0, np.where(digits == size, 5, 1 + np.minimum(3, digits * 4 // size))),
        np.searchsorted([2, 3, 4, 6, 10], changes, side="right"), total(_IS_HEX[data]) == size, opening, before, mark,
    ]
    return np.column_stack(columns).astype(np.int64) + _OFFSETS[:-1]


def file_features(marks: np.ndarray, digits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two feature numbers per text: how many of its tokens are = or :, and how many hold a digit."""
    share = lambda part: np.searchsorted([0.001, 0.01, 0.05, 0.2], part / np.maximum(1, n), side="right")
    return np.column_stack([share(marks), FILE["marks"] + share(digits)])


@dataclass
class Tokens:
    """Tokens of several texts: a code per token, where each text's tokens begin, features per code and per text."""

    codes: np.ndarray
    offsets: np.ndarray
    shapes: np.ndarray
    files: np.ndarray


def tokens_of(texts: list[str]) -> Tokens:
    spaced = [t.encode().translate(_SPACED).replace(b"=", b" = ").replace(b":", b" : ") for t in texts]
    lists = pc.ascii_split_whitespace(pa.array(spaced, pa.binary()).cast(pa.string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    filled = pc.not_equal(words, "")
    kept = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))[offsets - offsets[0]]
    coded = words.filter(filled).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = shapes(coded.dictionary) if len(coded.dictionary) else np.empty((0, len(SHAPE)), np.int64)
    per_token = found[codes]
    marks, digits = (sums(flags[:, None].astype(float), kept)[:, 0] for flags in (per_token[:, 7] > _OFFSETS[7], per_token[:, 2] > _OFFSETS[2]))
    return Tokens(codes, kept.astype(np.int64), found, file_features(marks, digits, np.diff(kept)))


# --- the field ---------------------------------------------------------------


@dataclass
class Field:
    """Weights: per neighbour, feature and tag; per file feature and tag; between tags; at a start."""

    shape: np.ndarray
    file: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def scores(self, t: Tokens) -> np.ndarray:
        """What each tag scores at each token, neighbours and file included."""
        found = np.zeros((len(t.codes), TAGS))
        text = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.offsets))
        for weights, step in zip(self.shape, NEIGHBOURS):
            each = weights[t.shapes].sum(axis=1)
            at = np.arange(len(t.codes)) + step
            inside = (at >= t.offsets[:-1][text]) & (at < t.offsets[1:][text])
            found[inside] += each[t.codes[at[inside]]]
        return found + self.file[t.files].sum(axis=1)[text]

    def slack(self) -> float:
        """What another tag than outside can gain by its moves at most."""
        m, others = self.moves, range(1, TAGS)
        between = max(m[p, y] + m[y, n] - m[p, 0] - m[0, n] for p in range(TAGS) for y in others for n in range(TAGS))
        first = max(self.start[y] + m[y, n] - self.start[0] - m[0, n] for y in others for n in range(TAGS))
        last = max(m[p, y] - m[p, 0] for p in range(TAGS) for y in others)
        return max(between, first, last, max(self.start[1:]) - self.start[0])


def viterbi(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """The best tags of one sequence; ``end`` is added to the last one."""
    best, back = start + scores[0], []
    for row in scores[1:]:
        paths = best[:, None] + moves
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    tag = int((best if end is None else best + end).argmax())
    tags = [tag]
    for step in reversed(back):
        tag = int(step[tag])
        tags.append(tag)
    return np.array(tags[::-1])


def decode(field: Field, t: Tokens) -> np.ndarray:
    """The best tag of every token.

    A token whose outside score leads by more than moves can ever make up for
    is outside on every best path. The stretches between such tokens are
    decoded by Viterbi, each by itself, and together give the best path whole.
    """
    scores = field.scores(t)
    tags = np.zeros(len(scores), np.int64)
    open_ = scores[:, 1:].max(axis=1, initial=-np.inf) - scores[:, 0] + field.slack() >= -1e-9
    begins, ends = np.zeros(len(scores) + 1, bool), np.zeros(len(scores) + 1, bool)
    begins[t.offsets[:-1]], ends[t.offsets[1:]] = True, True
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    new = np.concatenate(([True], (np.diff(at) > 1) | begins[at[1:]]))
    for first, last in zip(at[new], np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])):
        enter = field.start if begins[first] else field.moves[0]
        leave = None if ends[last + 1] else field.moves[:, 0]
        tags[first : last + 1] = viterbi(scores[first : last + 1], field.moves, enter, leave)
    return tags


def tag_runs(tags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each secret: a begin tag, or an inside one after an outside one, with the inside tags that follow."""
    inside = tags > 0
    first = np.flatnonzero(inside & ((tags == 1) | ~np.concatenate(([False], inside[:-1]))))
    last = np.flatnonzero(inside & ~np.concatenate((inside[1:] & (tags[1:] == 2), [False])))
    return list(zip(first.tolist(), (last + 1).tolist()))


def fit(windows: list[tuple[list[str], list[int], list[int]]], epochs: int = EPOCHS) -> Field:
    """Fits the field to ``(tokens, tags, file features)`` windows by its log-likelihood (forward and backward sums, Adam steps)."""
    words, numbers = [w for tokens, _, _ in windows for w in tokens], {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    features = shapes(pa.array(list(numbers), pa.string()))[codes]
    sizes = np.array([len(tokens) for tokens, _, _ in windows])
    offsets, longest = np.concatenate(([0], np.cumsum(sizes))), int(sizes.max())
    text = np.repeat(np.arange(len(windows)), sizes)
    column = np.arange(len(words)) - offsets[:-1][text]
    gold = np.array([tag for _, tags, _ in windows for tag in tags])
    files = np.array([f for _, _, f in windows])[text]
    near = []
    for step in NEIGHBOURS:
        at = np.arange(len(words)) + step
        inside = np.flatnonzero((at >= offsets[:-1][text]) & (at < offsets[1:][text]))
        near.append((inside, features[at[inside]]))
    goal = np.eye(TAGS)[gold]
    follows = np.flatnonzero(column > 0)
    goal_moves, goal_start = np.zeros((TAGS, TAGS)), goal[column == 0].sum(axis=0)
    np.add.at(goal_moves, (gold[follows - 1], gold[follows]), 1)
    there = np.zeros((len(windows), longest), bool)
    there[text, column] = True
    parts = [np.zeros((len(NEIGHBOURS), N_SHAPE, TAGS)), np.zeros((N_FILE, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for epoch in range(1, epochs + 1):
        shape, file, moves, start = parts
        flat = file[files].sum(axis=1)
        for weights, (inside, own) in zip(shape, near):
            flat[inside] += weights[own].sum(axis=1)
        scores = np.zeros((len(windows), longest, TAGS))
        scores[text, column] = flat
        forward = np.empty_like(scores)
        forward[:, 0] = start + scores[:, 0]
        for i in range(1, longest):
            step = np.logaddexp.reduce(forward[:, i - 1, :, None] + moves, axis=1) + scores[:, i]
            forward[:, i] = np.where(there[:, i, None], step, forward[:, i - 1])
        norm = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward, expected_moves = np.zeros_like(scores), np.zeros((TAGS, TAGS))
        for i in range(longest - 1, 0, -1):
            after = scores[:, i] + backward[:, i]
            both = forward[:, i - 1, :, None] + moves + after[:, None, :] - norm[:, None, None]
            expected_moves += np.exp(both)[there[:, i]].sum(axis=0)
            backward[:, i - 1] = np.where(there[:, i, None], np.logaddexp.reduce(moves + after[:, None, :], axis=2), 0)
        share = np.exp(forward + backward - norm[:, None, None])[text, column]
        miss = share - goal
        slopes = [np.zeros_like(p) for p in parts]
        for tag in range(TAGS):
            for k, (inside, own) in enumerate(near):
                slopes[0][k, :, tag] = np.bincount(own.ravel(), np.repeat(miss[inside, tag], own.shape[1]), N_SHAPE)
            slopes[1][:, tag] = np.bincount(files.ravel(), np.repeat(miss[:, tag], files.shape[1]), N_FILE)
        slopes[2], slopes[3] = expected_moves - goal_moves, share[column == 0].sum(axis=0) - goal_start
        for part, mean, square, slope in zip(parts, means, squares, slopes):
            slope = slope / len(windows) + PENALTY * part
            mean[...], square[...] = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            part -= RATE * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.99**epoch)) + 1e-6)
    return Field(*parts)


# --- what it learns from -------------------------------------------------------


def made_windows(n: int = 600, seed: int = 11) -> list[tuple[list[str], list[int], list[int]]]:
    """Lines of made-up settings and logs: credentials of forms that the base patterns do not know, and plain values beside them."""
    draw = np.random.default_rng(seed)
    pick = lambda options: options[int(draw.integers(len(options)))]
    digits, small = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    capital = small.upper()
    some = lambda letters, low, high: "".join(pick(letters) for _ in range(int(draw.integers(low, high + 1))))
    mixed = small + capital + digits
    secrets = [
        lambda: pick(["ghp_", "gho_", "pat_", "npm_"]) + some(mixed, 30, 40), lambda: pick(["sk_live_", "rk_test_", "sk-"]) + some(mixed, 20, 40),
        lambda: f"xoxb-{some(digits, 10, 12)}-{some(mixed, 20, 26)}", lambda: ".".join(["eyJ" + some(mixed, 15, 30), "eyJ" + some(mixed, 20, 60), some(mixed + "_-", 20, 43)]),
        lambda: some(mixed + "+/", 28, 64), lambda: some(digits + "ABCDEF", 24, 48), lambda: some(mixed, 20, 32),
    ]
    weak = lambda: pick([some(mixed + "_-", 8, 20), some(small, 5, 9) + some(digits, 2, 5) + pick(["", "!", "_x"])])
    plain = [
        lambda: some(small, 2, 10), lambda: some(digits, 1, 10), lambda: f"{some(digits, 1, 2)}.{some(digits, 1, 2)}.{some(digits, 1, 3)}", lambda: ".".join(some(digits, 1, 3) for _ in range(4)),
        lambda: pick(["true", "false", "null", "blue", "info", "utf-8"]), lambda: "/" + "/".join(some(small, 3, 8) for _ in range(3)), lambda: some(capital, 1, 1) + some(small, 3, 9),
        lambda: f"20{some(digits, 2, 2)}-0{some('123456789', 1, 1)}-1{some(digits, 1, 1)}", lambda: f"{some(small, 4, 8)}.{some(small, 4, 8)}@{some(small, 4, 8)}.example.com",
        lambda: f"{some(small, 4, 8)}_{some(small, 4, 8)}", lambda: some(small, 3, 6) + some(capital, 1, 1) + some(small, 3, 8), lambda: f"555-{some(digits, 4, 4)}", lambda: "-".join(some(small, 3, 8) for _ in range(3)),
    ]
    named, other = ["pwd", "pass", "passphrase", "auth", "credential", "access_key", "private_key", "db_pass", "signing_key"], ["timeout", "color", "name", "host", "port", "path", "version", "level", "user", "mode"]
    found = []
    for _ in range(n):
        tokens, tags = [], []

        def add(words, tag=0):
            tokens.extend(words)
            tags.extend([0] * len(words) if not tag else [1] + [2] * (len(words) - 1))

        for _ in range(int(draw.integers(2, 6))):
            add([pick(plain)() for _ in range(int(draw.integers(0, 5)))])
            form = int(draw.integers(6))
            if form == 0:
                add([pick(named), pick("=:"), pick(secrets)()], 1)
            elif form == 1:
                add([pick(named), pick("=:"), weak()], 1)
            elif form == 2:
                add([pick(secrets)()], 1)
            elif form == 3:
                add(["Authorization", ":"])
                add(["Bearer", pick(secrets)()], 1)
            else:
                add([pick(other), pick("=:"), pick(plain)()])
        parts = [w for token in tokens for w in TOKEN.findall(token)]
        if len(parts) == len(tokens):
            marks, digit = sum(t in "=:" for t in tokens), sum(any(c in digits for c in t) for t in tokens)
            found.append((tokens, tags, file_features(np.array([marks]), np.array([digit]), np.array([len(tokens)]))[0].tolist()))
    return found


def labelled_windows(text: str) -> list[tuple[list[str], list[int]]]:
    """Windows of one text with tags from the base patterns: around its first secrets, and one where there is none."""
    places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    if not places:
        return []
    starts = np.array([p[0] for p in places])
    tags, free, centres = np.zeros(len(places), np.int64), 0, []
    for start, end, _ in base_spans(text):
        if start >= free:
            first = max(0, int(np.searchsorted(starts, start, side="right")) - 1)
            last = int(np.searchsorted(starts, end, side="left"))
            tags[first:last], tags[first] = 2, 1
            centres.append(first)
            free = end
    calm = int(hashlib.md5(text.encode()).hexdigest(), 16) % len(places)
    found = []
    for centre in centres[: WINDOWS_A_ROW - 1] + [calm]:
        low, high = max(0, centre - REACH), min(len(places), centre + REACH + 3)
        while high < len(places) and tags[high] == 2:
            high += 1
        found.append(([text[a:z] for a, z in places[low:high]], tags[low:high].tolist()))
    return found


def learn(docs: DataFrame, rows: int = TRAINING_ROWS, most: int = TRAINING_WINDOWS) -> Field:
    """A field fitted to made-up lines and to windows from a sample of ``docs``, tagged by the base patterns.

    About ``rows`` documents are drawn by a hash of id and text, and at most
    ``most`` of their windows, of some 30 tokens each, come to the driver.
    """

    def cut_out(batches):
        for piece in slices(batches, "text"):
            texts = [t for t in piece.column("text").to_pylist() if t]
            files = tokens_of(texts).files.tolist() if texts else []
            made = [(*w, f) for t, f in zip(texts, files) for w in labelled_windows(t)]
            kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in made], k) for i, k in enumerate(kinds)], ["tokens", "tags", "file"])

    texts = docs.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)).alias("draw"))
    share = rows / max(rows, docs.count())
    drawn = texts.where(F.col("draw") < int(share * 1_000_000)).select("text").mapInArrow(cut_out, "tokens array<string>, tags array<bigint>, file array<bigint>")
    # Windows with secrets first: texts without any are most of a sample.
    kept = drawn.orderBy(F.array_max("tags").desc(), F.xxhash64("tokens"), "tags", "file").limit(most // 2)
    calm = drawn.where(F.array_max("tags") == 0).orderBy(F.xxhash64("tokens"), "file").limit(most // 2)
    windows = [(r["tokens"], r["tags"], r["file"]) for df in (kept.where(F.array_max("tags") > 0), calm) for r in df.collect()]
    return fit(made_windows() + windows)


# --- the scan ------------------------------------------------------------------


def scan_texts(field: Field, texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text, in order."""
    t = tokens_of(texts)
    tags = decode(field, t)
    for i, text in enumerate(texts):
        base = base_spans(text)
        own = tags[t.offsets[i] : t.offsets[i + 1]]
        found = list(base)
        if own.any():
            places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
            starts, ends = (np.array([s[k] for s in base]) for k in (0, 1))
            for first, last in tag_runs(own):
                start, end = places[first][0], places[last - 1][1]
                end -= len(text[start:end]) - len(text[start:end].rstrip(".")) if text[start:end].strip(".") else 0
                if not len(base) or not ((starts < end) & (ends > start)).any():
                    found.append((start, end, 3))
        yield base, sorted(found, key=lambda s: (s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans`` of every row of ``docs`` (``doc_id``, ``text``).

    ``spans`` lists ``kind:start:end`` by start, then kind: the matches of the
    base patterns, and runs of tokens that the field (``learn`` from these
    ``docs`` unless given) tags as a secret and that meet no base match, of kind
    ``crf``. A null text counts as empty and has no spans; repeated rows and
    null ids are kept as they come; other columns are ignored.
    """
    field = field or learn(docs)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for piece in slices(batches, "text", WORD_SLICE_BYTES):
            base, spans = zip(*scan_texts(sent.value, [t or "" for t in piece.column("text").to_pylist()]))
            counts = [[sum(s[2] == kind for s in found) for found in spans] for kind in range(4)]
            digests = [hashlib.sha256(listed(found).encode()).hexdigest() for found in base]
            arrays = [piece.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array([listed(s) for s in spans], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")
