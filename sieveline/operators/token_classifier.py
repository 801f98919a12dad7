"""A small softmax classifier for secret-like tokens that no rule names: trained on the driver on generated tokens of a
fixed seed, and applied as one matrix product a batch."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .privacy import RULES

TOKEN = re.compile(r"[A-Za-z0-9+/_\-:.@]{12,}")
CLASSES = ["benign", "api_key", "api_token", "password", "high_entropy_token"]
BUCKETS, CONFIDENT = 512, 0.9


def features(token: str) -> np.ndarray:
    """Hashed character trigrams, and shape: length, shares of character classes, entropy."""
    v = np.zeros(BUCKETS + 6)
    padded = f"^{token}$"
    for i in range(len(padded) - 2):
        a, b, c = map(ord, padded[i : i + 3])
        v[(a * 8191 + b * 131 + c) % BUCKETS] += 1 / len(token)
    n = len(token)
    shares = [c / n for c in Counter(token).values()]
    v[BUCKETS:] = [min(1.0, n / 60), sum(map(str.isdigit, token)) / n, sum(map(str.isupper, token)) / n, sum(map(str.islower, token)) / n, sum(not c.isalnum() for c in token) / n, -sum(p * math.log2(p) for p in shares) / 6]
    return v


def generated(seed: int, each: int) -> list[tuple[str, int]]:
    rng = random.Random(seed)
    some = lambda alphabet, low, high: "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    words = ["config", "service", "discount", "pricing", "module", "handler", "customer", "inventory", "report", "settings"]
    made = {
        0: lambda: rng.choice("_-./").join(rng.choice(words) for _ in range(rng.randint(2, 4))),
        1: lambda: some(string.ascii_uppercase + string.digits, 20, 24),
        2: lambda: rng.choice(["ghx_", "tok-", "key_"]) + some(string.ascii_letters + string.digits, 24, 36),
        3: lambda: rng.choice(words).title() + some(string.digits, 3, 5) + some("_-+@", 1, 2) + some(string.ascii_letters, 3, 6),
        4: lambda: some(string.ascii_letters + string.digits + "+/", 32, 48),
    }
    return [(made[c](), c) for _ in range(each) for c in made]


def train(seed: int = 20260102, each: int = 200, epochs: int = 60, rate: float = 0.5) -> np.ndarray:
    rows = [r for r in generated(seed, each) if len(r[0]) >= 12]
    x = np.array([[*features(t), 1.0] for t, _ in rows])
    y = np.eye(len(CLASSES))[[c for _, c in rows]]
    w = np.zeros((x.shape[1], len(CLASSES)))
    for _ in range(epochs * 10):
        w -= rate * (x.T @ (softmax(x @ w) - y) / len(x) * 4 + 1e-5 * w)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and the confident tokens of every row that no rule covers: kind, value, start, end, confidence."""
    shared = rows.sparkSession.sparkContext.broadcast(train())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out = []
            for body in b.column("text").to_pylist():
                covered = [m.span() for rule in RULES.values() for m in re.finditer(rule, body or "")]
                free = [m for m in TOKEN.finditer(body or "") if not any(m.start() < e and s < m.end() for s, e in covered)]
                p = softmax(np.array([[*features(m[0]), 1.0] for m in free]) @ w) if free else np.zeros((0, len(CLASSES)))
                out.append([{"kind": CLASSES[k], "value": m[0], "start": m.start(), "end": m.end(), "confidence": float(q)} for m, k, q in zip(free, p.argmax(1).tolist(), p.max(1).tolist(), strict=True) if k and q >= CONFIDENT])
            yield pa.record_batch([b.column(key), pa.array(out, kind)], names=[key, "found"])

    return rows.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, f"{key} long, found array<struct<kind:string,value:string,start:int,end:int,confidence:double>>")
