"""The whole pipeline against plain Python that knows neither Spark nor numpy batches."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from test_decontaminate import slow_align
from test_mixing import filled
from test_simhash import by_hand as print_of
from test_simhash import reach
from tokenizers import Tokenizer

import corpus_pipeline
from nearfield.llm import quality, textscan
from nearfield.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def score(trees, text):
    data, offsets = textscan.texts(pa.array([text]))
    x, total = quality.statistics(data, offsets)[0], trees.base
    for feature, bound, leaf in zip(trees.feature, trees.bound, trees.leaf):
        node = 0
        while node < len(bound):
            node = 2 * node + (2 if x[feature[node]] > bound[node] else 1)
        total += leaf[node - len(bound)]
    return 1 / (1 + np.exp(-total))


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010FFFF]+", "".join(c.lower() if c < "\x80" else c for c in text))


def leaked(text, items):
    own = words(text)
    grams = {tuple(own[i : i + 4]) for i in range(len(own) - 3)}
    return any(
        grams & {tuple(item[i : i + 4]) for i in range(len(item) - 3)}
        and slow_align(item, own) >= 0.6 * 2 * len(item) for item in items)


def copies(docs):
    """How often the mix takes each document."""
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    whole = {}
    for d in docs:
        whole[d["source"]] = whole.get(d["source"], 0) + size[d["doc_id"]]
    names = sorted(s for s in whole if s is not None) + [s for s in whole if s is None]
    target = filled(whole, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, 2)
    out = {}
    for s in whole:
        times = int(target[s] // whole[s])
        extra, start = target[s] - times * whole[s], 0
        own = [d["doc_id"] for d in docs if d["source"] == s]
        for i in sorted(own, key=lambda i: hashlib.md5(f"17:{i}".encode()).hexdigest()):
            out[i] = times + (extra > 0 and start + size[i] / 2 <= extra)
            start += size[i]
    return out


def test_pipeline_by_hand(spark):
    docs, tokenizer = rows("documents"), Tokenizer.from_file(tokenizer_path())
    trees = quality.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    docs = [d | {"text": d["text"] or ""} for d in docs]
    good = [d for d in docs if score(trees, d["text"]) >= 0.5]
    of = reach({d["doc_id"]: print_of(d["text"]) for d in good})
    single = [d for d in good if of[d["doc_id"]] == d["doc_id"]]
    items = [words(r["text"]) for r in rows("benchmark")]
    clean = [d for d in single if not leaked(d["text"], items)]
    assert len(docs) > len(good) > len(single) > len(clean) > 0
    times = copies(clean)
    expected, start = [], 0
    for d in sorted(clean, key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 2]
        for _ in range(times[d["doc_id"]]):
            expected.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert found == sorted(expected)
