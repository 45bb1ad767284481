"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of token characters with a digit, values of
assignments with a telling name before them, and private-key blocks, closed or cut
off. What stands inside a block that is no key is judged, too. The forest judges each by its length,
the transitions between its characters, how much of it dictionary words cover,
the path that the text came from and the words around it. It is grown in numpy
from labelled findings: ``labelled_findings`` writes them by rule from the kinds
of strings that scanners of this sort meet (no table of labelled findings is
given), and a table of one's own can be passed instead.

Each text is scanned alone and whole, in the task that reads it; nothing is
shuffled. A null or empty text has no findings, a null path is an empty one, an
empty table gives no rows. ``redact`` needs the columns that it is told of.
Rows that share doc_id are scanned one by one; other columns are ignored, or
passed through by ``redact``. Candidates of any length are found and judged whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.llm.common import table

#: Labelled findings that the forest is grown from, its trees and depth.
FINDINGS, TREES, DEPTH = 6000, 40, 9
#: Score from which a candidate is a secret.
LEAST = 0.5
#: Characters on either side that count as neighbourhood.
AROUND = 48

_RUN = re.compile(r"[A-Za-z0-9_+/\-]{16,}(?:\.[A-Za-z0-9_+/\-]{8,}){0,2}={0,2}")
_VALUE = re.compile(r"[=:][ \t]{0,3}[\"'`]?([^\s\"'`,;<>()\[\]{}|]{6,})")
#: A sign that a value follows; values may hold further signs.
_SIGN = re.compile(r"[=:](?=[ \t]{0,3}[\"'`]?[^\s\"'`,;<>()\[\]{}|]{6})")
#: A key block: up to its END line, if that comes before another BEGIN, or else as far as its lines are base64.
_KEY = re.compile(
    r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(?:(?:(?!-----BEGIN ).)*?-----END \1-----"
    r"|(?:(?:\s|\\[nr]){1,8}(?:Proc-Type|DEK-Info): [^\n\\]*)*(?:(?:(?:\s|\\[nr]){1,8}[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/]))+(?:(?:\s|\\[nr]){1,8}[A-Za-z0-9+/]+(?:={1,2}|(?=[ \t]*(?:\\[nr]|[\r\n]|\Z))))?)?)",
    re.S,
)
_DIGIT = re.compile(r"\d")
#: What an assignment's value may be called.
_NAME = re.compile(r"(?i)(?:pass|pwd|secret|token|key|auth|cred|bearer|sign|salt|session)")
_WORDS = re.compile(r"[A-Za-z]{2,}")

# fixed values: words that secrets do not have but identifiers, names and examples do
_DICTIONARY = frozenset(
    "about access account action active admin after android angular apple application array async author backup base before beta "
    "binary block board body bool boot border bottom branch browser buffer build button byte cache calendar camera cell change "
    "channel char check class clear click client clock close cloud cluster code color column command comment commit common config "
    "connect console contact container content context control cookie copy core count country create current custom daily data date "
    "debug default delete demo design desktop detail device digest disable document domain download dummy dynamic editor email enable "
    "encode engine error event example export extra factory false field file filter final find first flag float folder font footer "
    "format forward frame free from function game general get global google graph green group handler hash header health height hello "
    "hidden home host html http icon image import index info init inner input install int interface internal item java job json label "
    "lang large last layer layout left length level library light limit line link list load local lock log login long loop mail main "
    "manager map master match max media member memory menu merge message method min mobile mode model module month mouse move name "
    "native network new next node none normal note null number object off offset old online open option order origin output owner "
    "package page panel parent parse part password patch path pattern phone photo place plain platform player plugin point policy "
    "pool port position post power preview price print private process product profile project property proxy public query queue quick "
    "random range rate read record red region release remote render reply report request reset resource response result return right "
    "role root route rule sample save scale schema screen script scroll search second section secure select send sender sequence "
    "server service session set setting shape share short show side simple single site size slide small social sort source space spec "
    "speed stack standard start state static status step stop storage store story stream string style submit success summary support "
    "switch sync system table target task team temp template test text theme thread three time title todo token tool top total trace "
    "track true type undefined unit update upload url user utils valid value vector version video view visible voice warning watch web "
    "week white width window word work world wrapper write year your zone".split()
)
_GOOD_NAMES = ("token", "secret", "passw", "pwd", "key", "auth", "cred", "bearer", "api", "private", "access")
_BAD_NAMES = ("example", "sample", "dummy", "placeholder", "your", "test", "fake", "changeme", "redacted", "xxxx")
_HASH_NAMES = ("sha", "md5", "commit", "checksum", "digest", "uuid", "guid", "hash", "integrity", "revision", "etag", "build")
_CODE_PATHS = (".env", "config", "settings", ".pem", ".yml", ".yaml", ".properties", ".ini", "credential")
_TEST_PATHS = ("test", "spec", "example", "sample", "docs", "fixture", "mock", ".lock", "readme")


@dataclass(frozen=True)
class Finding:
    """A candidate at [start, end) of a text, in code points."""

    start: int
    end: int
    kind: str
    value: str
    before: str
    after: str


def _finding(text: str, a: int, b: int, kind: str) -> Finding:
    return Finding(a, b, kind, text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND])


def candidates(text: str) -> list[Finding]:
    """Possible secrets, in order. None lies inside another, but for those inside key blocks, which count where the block is no key."""
    blocks = [_finding(text, *m.span(), "private_key") for m in _KEY.finditer(text)] if "-----BEGIN " in text else []
    spans: list[tuple[int, int, str]] = []
    for m in _RUN.finditer(text):
        if _DIGIT.search(text, *m.span()):
            spans.append((*m.span(), "token"))
    names = [m.start() for m in _NAME.finditer(text)]
    taken = last = 0
    for m in _SIGN.finditer(text):
        # the name stands between the sign or line break before and this sign, however long that is;
        # what stands inside a value that is taken ends with it
        k = bisect_left(names, m.start()) - 1
        if m.end() >= taken and k >= 0 and names[k] >= max(last, text.rfind("\n", last, m.start())):
            a, taken = _VALUE.match(text, m.start()).span(1)
            spans.append((a, taken, "assignment"))
        last = m.start()
    found, end = [], -1
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= end:
            found.append(_finding(text, a, b, kind))
            end = b
        elif b > end:  # two patterns overlap: both are covered
            last = found.pop()
            found.append(Finding(last.start, b, last.kind, text[last.start : b], last.before, text[b : b + AROUND]))
            end = b
    return sorted(blocks + found, key=lambda f: (f.start, -f.end)) if blocks else found


def _outside_keys(found: list[tuple[Finding, float]]) -> list[tuple[Finding, float]]:
    """What is left beside the blocks that are keys: candidates in them go, and one that runs into a block ends there."""
    keys = [f for f, s in found if f.kind == "private_key" and s >= LEAST]
    if not keys:
        return found
    starts, left = [k.start for k in keys], []
    for f, s in found:
        if f in keys:
            left.append((f, s))
            continue
        k = bisect_right(starts, f.start) - 1
        if k >= 0 and f.start < keys[k].end:
            continue
        end = min(f.end, starts[k + 1]) if k + 1 < len(starts) else f.end
        left.append((f if end == f.end else replace(f, end=end, value=f.value[: end - f.start]), s))
    return left


def _coverage(value: str) -> float:
    """Part of the value that dictionary words of its letter runs cover, longest word first."""
    covered = 0
    for run in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)):
        low, i = run.lower(), 0
        while i < len(low):
            for n in range(min(11, len(low) - i), 2, -1):
                if low[i : i + n] in _DICTIONARY:
                    covered += n
                    i += n
                    break
            else:
                i += 1
    return covered / max(1, len(value))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(finding: Finding, path: str) -> list[float]:
    value = finding.value
    n = max(1, len(value))
    kinds = [_class(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    steps = [0.0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        steps[4 * a + b] += 1 / n
    counts = [value.count(c) / n for c in set(value)]
    entropy = -sum(p * math.log2(p) for p in counts)
    vowels = sum(c in "aeiouAEIOU" for c in value) / n
    runs = [len(m.group()) for m in re.finditer(r"(.)\1*", value)]
    longest = max(runs, default=0)
    name = finding.before[-28:].lower()
    around = (finding.before + " " + finding.after).lower()
    low, where = value.lower(), path.lower()

    def has(text: str, words: tuple[str, ...]) -> float:
        return float(any(w in text for w in words))

    return [
        len(finding.value), math.log2(len(finding.value) + 1), entropy, entropy / math.log2(n + 1), *share, *steps, vowels, longest / n,
        _coverage(value), float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        len(set(value)) / n, value.count("/") / n, value.count("-") / n, value.count(".") / n, value.count("_") / n,
        has(name, _GOOD_NAMES), has(low, _BAD_NAMES), has(around, _BAD_NAMES), has(name, _HASH_NAMES), float("://" in around or "www." in around),
        float(finding.before.rstrip()[-1:] in ("=", ":") or finding.before[-1:] in "\"'`" and bool(finding.before)),
        math.log2(1 + n / max(1, len(re.findall(r"(?:[^\s\\]|\\[^nr])+", value)))),  # its pieces: lines of a key, or words
        has(where, _CODE_PATHS), has(where, _TEST_PATHS), float(finding.kind == "private_key"), float(finding.kind == "assignment"),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, path, 1 if the text's candidate is a secret), half of each, by rule."""
    r = random.Random(seed)
    words = sorted(_DICTIONARY)
    b62 = string.ascii_letters + string.digits

    def take(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    def secret() -> str:
        return r.choice([
            lambda: take("0123456789abcdef", r.choice([32, 40, 40, 48, 64])), lambda: take("0123456789ABCDEF", r.choice([32, 40, 40, 64])), lambda: take(b62, r.randrange(16, 64)),
            lambda: "AKIA" + take(string.ascii_uppercase + string.digits, 16), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + take(b62, 36),
            lambda: r.choice(["sk-", "sk_live_", "rk_live_", "glpat-", "xoxb-"]) + take(b62, r.randrange(20, 48)), lambda: "AIza" + take(b62 + "-_", 35),
            lambda: base64.b64encode(r.randbytes(r.randrange(16, 48))).decode(), lambda: take(b62 + "!@#$%^&*", r.randrange(10, 24)),
            lambda: "eyJ" + take(b62, 20) + "." + take(b62, 40) + "." + take(b62 + "-_", 43),
        ])()

    def key_block(body: str) -> str:
        kind = r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY"
        # some are cut off
        return f"-----BEGIN {kind}-----{body}" + (f"-----END {kind}-----" if r.random() < 0.75 else "\n")

    def private_key() -> str:
        body = base64.b64encode(r.randbytes(r.choice([12, 15, 24, 32, 48, 120, 300, 600, 1200]))).decode()
        line = r.choice(["\n", "\n", "\\n", " "])
        return key_block(line + line.join(body[k : k + 64] for k in range(0, len(body), 64)) + line)

    def no_key() -> str:
        """A block that only shows what a key looks like."""
        inside = r.choice([
            lambda: "\n...\n", lambda: "", lambda: " " + prose(r.randrange(1, 20)) + "\n", lambda: "\n" + "x" * r.randrange(8, 80) + "\n", lambda: " your key here ", lambda: "\n<" + " ".join(r.sample(words, 3)) + ">\n",
            lambda: "\n" + " ".join(r.sample(words, r.randrange(5, 30))) + "\n", lambda: "\nEXAMPLE" + "A" * r.randrange(10, 60) + "\n", lambda: "\n[REDACTED]\n",
        ])()
        return key_block(inside)

    def harmless() -> str:
        hexes = "0123456789abcdef"
        return r.choice([
            lambda: "_".join(r.sample(words, 3)) + str(r.randrange(100)), lambda: "".join(w.capitalize() for w in r.sample(words, 4)) + str(r.randrange(10)),
            lambda: "/".join(r.sample(words, 4)) + f"/v{r.randrange(9)}", lambda: "-".join(r.sample(words, 3)) + f"-{r.randrange(2000, 2030)}",
            lambda: take("0123456789", r.choice([10, 13, 16, 16, 20])), lambda: r.choice(["your_", "example-", "test_", "dummy", "sample-"]) + "_".join(r.sample(words, 2)) + "_" + str(r.randrange(1, 1000)),
            lambda: r.choice(["x", "*", "0", "a1", "abc123", "1234567890"]) * r.randrange(8, 20), lambda: f"{take(hexes, 8)}-{take(hexes, 4)}-{take(hexes, 4)}-{take(hexes, 4)}-{take(hexes, 12)}",
            lambda: f"20{r.randrange(10, 30)}-0{r.randrange(1, 9)}-1{r.randrange(9)}T0{r.randrange(9)}-3{r.randrange(9)}-00-000", lambda: "".join(r.sample(words, 3)) + str(r.randrange(9)),
        ])()

    def prose(k: int) -> str:
        return " ".join(take(string.ascii_lowercase, r.randrange(2, 9)) if r.random() < 0.5 else r.choice(words) for _ in range(k))

    names = ["token", "secret", "api_key", "apikey", "password", "passwd", "auth_token", "access_key", "client_secret", "private_key", "TOKEN", "SECRET_KEY", "Authorization: Bearer"]
    plain = ["path", "url", "id", "name", "file", "class", "version", "image", "key", "tag", "see", "ref", "number", "order", "session"]
    hashes = ["commit", "sha1", "sha256", "md5", "checksum", "integrity", "digest", "revision"]
    secret_paths = ["app/.env", "config/settings.yml", "src/client.py", "deploy.sh", "web", ""]
    harmless_paths = ["tests/fixtures/a.json", "docs/readme.md", "package.lock", "src/main.ts", "web", ""]
    out: list[tuple[str, str, int]] = []
    while len(out) < n:
        label = len(out) % 2
        if r.random() < 0.16:  # key blocks, whole or cut off, and such that hold none
            path = r.choice(secret_paths if r.random() < 0.6 else harmless_paths)
            out.append((f"{prose(4)}\n{private_key() if label else no_key()}\n{prose(4)}", path, label))
            continue
        if label:
            name, value, path = r.choice(names), secret(), r.choice(secret_paths if r.random() < 0.8 else harmless_paths)
        elif r.random() < 0.2:  # digests of commits and files look like secrets but for their names
            name, value, path = r.choice(hashes), take("0123456789abcdef", r.choice([32, 40, 64])), r.choice(harmless_paths)
        else:
            name, value, path = r.choice(plain if r.random() < 0.7 else names), harmless(), r.choice(harmless_paths if r.random() < 0.7 else secret_paths)
        q = r.choice(['"', "'", "", '"'])
        sign = r.choice([" = ", "=", ": ", " "]) if not label or r.random() < 0.1 else r.choice([" = ", "=", ": "])
        out.append((f"{prose(4)} {name}{sign}{q}{value}{q} {prose(4)}", path, label))
    return out


def prose_in_blocks(n: int = 200, seed: int = 12) -> list[tuple[str, str, int]]:
    """Blocks that hold prose with a secret in it: the block is no key. Labelled like ``labelled_findings``."""
    r = random.Random(seed)
    words, letters = sorted(_DICTIONARY), string.ascii_letters + string.digits

    def word() -> str:
        """Of the dictionary or not, some with a capital or a sign."""
        found = r.choice(words) if r.random() < 0.4 else "".join(r.choices(string.ascii_lowercase, k=r.randrange(1, 9)))
        return r.choice([found, found, found, found.capitalize(), found + r.choice(",.")])

    out = []
    for _ in range(n):
        before, after = (" ".join(word() for _ in range(r.randrange(3, 16))) for _ in range(2))
        secret = "".join(r.choices(letters, k=r.randrange(10, 44)))
        end = r.choice(["-----END PRIVATE KEY-----", "\n-----END PRIVATE KEY-----"])
        out.append((f"-----BEGIN PRIVATE KEY----- {before}. {r.choice(['token', 'api_key', 'password'])} = {secret} {after} {end}", r.choice(["web", "src/client.py", ""]), 0))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, children, and the leaf's score."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, child, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                at = np.where(f < 0, at, child[at] + right)
            total += value[at]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 5) -> Forest:
    """A random forest: bootstrap rows, random features at each node, Gini impurity."""
    rng = np.random.default_rng(seed)
    k = max(1, int(math.sqrt(x.shape[1])) + 1)
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, threshold, child, value = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            rate = y[own].mean()
            value[node] = rate
            if depth == DEPTH or len(own) < 6 or rate in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], k, replace=False):
                order = np.argsort(x[own, f], kind="stable")
                v, t = x[own, f][order], np.cumsum(y[own][order])
                n = np.arange(1, len(own))
                edge = v[1:] > v[:-1]
                if not edge.any():
                    continue
                left, right = t[:-1] / n, (t[-1] - t[:-1]) / (len(own) - n)
                gini = n * left * (1 - left) + (len(own) - n) * right * (1 - right)
                gain = np.where(edge, len(own) * rate * (1 - rate) - gini, -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    middle = (v[i] + v[i + 1]) / 2
                    best = (gain[i], f, middle if middle < v[i + 1] else v[i])  # the sum may round up
            if best[1] < 0:
                continue
            feature[node], threshold[node], child[node] = int(best[1]), float(best[2]), len(feature)
            high = x[own, best[1]] > best[2]
            for side in (own[~high], own[high]):
                todo.append((len(feature), side, depth + 1))
                feature.append(-1)
                threshold.append(0.0)
                child.append(0)
                value.append(0.0)
        grown.append((np.array(feature), np.array(threshold), np.array(child), np.array(value)))
    return Forest(grown)


def train(findings: list[tuple[str, str, int]] | None = None) -> Forest:
    """The forest of labelled findings (text, path, label): each text's first candidate."""
    x, y = [], []
    for text, path, label in findings if findings is not None else labelled_findings() + prose_in_blocks():
        if found := candidates(text):
            x.append(features(found[0], path))
            y.append(label)
    return grow(np.array(x, float), np.array(y, float))


def judge(forest: Forest, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[Finding, float]]]:
    """Candidates of each text with their scores; those inside a block that is a key are part of it."""
    found = [candidates(t) if t else [] for t in texts]
    x = [features(f, p or "") for fs, p in zip(found, paths, strict=True) for f in fs]
    scores = iter(forest.score(np.array(x, float)).tolist() if x else ())
    return [_outside_keys([(f, next(scores)) for f in fs]) for fs in found]


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate: id_col, start, end (code points), kind, value_sha256, score, is_secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for low in range(0, len(batch), 512):
                ids, texts, paths = (batch.slice(low, 512).column(k).to_pylist() for k in range(3))
                for doc, fs in zip(ids, judge(forest, texts, paths), strict=True):
                    rows += [(doc, f.start, f.end, f.kind, hashlib.sha256(f.value.encode()).hexdigest(), s, s >= LEAST) for f, s in fs]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "end", "kind", "value_sha256", "score", "is_secret"])

    found = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(path_col).cast("string"))
    return found.mapInArrow(run, "id long, start long, end long, kind string, value_sha256 string, score double, is_secret boolean").withColumnRenamed("id", id_col)


def mask(text: str, found: list[tuple[Finding, float]]) -> str:
    """The text with a mark in place of each secret."""
    parts, at = [], 0
    for f, s in found:
        if s >= LEAST:
            parts += [text[at : f.start], f"[{f.kind.upper()}]"]
            at = f.end
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns of docs; secrets in the text are masked and chars_col follows where the text has changed."""
    at = [docs.columns.index(c) for c in (text_col, path_col, chars_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                texts, paths, sizes = (part.column(k).to_pylist() for k in at)
                for i, found in enumerate(judge(forest, texts, paths)):
                    if any(s >= LEAST for _, s in found):
                        texts[i] = mask(texts[i], found)
                        sizes[i] = len(texts[i])
                part = part.set_column(at[0], part.schema.field(at[0]), pa.array(texts, part.column(at[0]).type))
                yield part.set_column(at[2], part.schema.field(at[2]), pa.array(sizes, part.column(at[2]).type))

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with their scores."""
    return scan(table(spark, sf_dir, "documents"), train())
