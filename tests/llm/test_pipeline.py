"""Every stage of the pipeline against a plain computation on its own input, and the whole run."""

import collections
import re

import pytest

import corpus_pipeline
from adlens.llm import packing, toxicity

from .conftest import DATA, SHARED, tables
from .test_queries import brute_simhash


def planted(spark):
    """Documents with copies, near copies, shared passages, repeated and null ids, null and empty texts."""
    docs = tables(spark, "documents")
    whole = sorted((r.doc_id, r.text) for r in docs.collect() if r.text and len(r.text.split()) > 80)
    odd = [(5000, whole[0][1]), (5000, whole[1][1].replace(" ", "\n\t")), (None, whole[2][1]), (whole[3][0], whole[3][1])]
    odd += [(5001, whole[4][1] + " end"), (5001, "x " + whole[5][1]), (None, whole[6][1] + " end")]
    odd += [(5002, "é " * 30 + SHARED * 2), (5003, "漢字 " * 20 + SHARED * 2 + "z"), (5002, "alone " + SHARED)]
    odd += [(5004, None), (5005, ""), (None, None), (5006, " \n"), (5007, " ".join(f"w{i}" for i in range(20_000)))]
    more = spark.createDataFrame([(i, t, "en", None, None) for i, t in odd], docs.schema)
    return docs.unionByName(more)


def pairs(frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def least(keys):
    return min((k for k in keys if k is not None), default=None)


def not_toxic(spark, before, docs, folder):
    said = toxicity.toxicity(docs.drop("n_chars"), spark.read.parquet(f"{folder}/labels.parquet"))
    by_id = collections.defaultdict(list)
    for r in said.collect():
        by_id[r.doc_id].append(r.predicted)
    sizes = collections.Counter()
    for (key, _), n in before.items():
        sizes[key] += n
    assert {k: len(v) for k, v in by_id.items()} == dict(sizes)
    return {k: v.count(0) for k, v in by_id.items()}


def brute_copies(before):
    groups = collections.defaultdict(list)
    for key, text in before.elements():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    return collections.Counter((least(keys), text) for text, keys in groups.items())


def near_classes(before):
    prints = collections.defaultdict(list)
    for key, text in before.elements():
        prints[brute_simhash(text)].append((key, text))
    classes, left = [], set(prints)
    while left:
        inside, edge = set(), {left.pop()}
        while edge:
            at = edge.pop()
            inside.add(at)
            close = {p for p in left if bin(p ^ at).count("1") <= 4}
            left -= close
            edge |= close
        classes.append([row for p in inside for row in prints[p]])
    return classes


def brute_passages(before):
    """Rows with what is left of their texts; a character goes if one of its bytes does."""
    order = lambda k: float("inf") if k is None else k
    first, out = {}, collections.Counter()
    for key, text in before:
        data = (text or "").encode()
        for at in range(len(data) - 49):
            window = data[at : at + 50]
            first[window] = min(first.get(window, float("inf")), order(key))
    for key, text in before.elements():
        data, kept, at = (text or "").encode(), [], 0
        gone = bytearray(len(data))
        for start in range(len(data) - 49):
            if first[data[start : start + 50]] < order(key):
                gone[start : start + 50] = b"\1" * 50
        for letter in text or "":
            size = len(letter.encode())
            if not any(gone[at : at + size]):
                kept.append(letter)
            at += size
        out[key, "".join(kept)] += 1
    return out


def test_stages_and_run(spark, tmp_path):
    source = planted(spark)
    source.write.parquet(f"{tmp_path}/documents.parquet")
    tables(spark, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = pairs(docs)
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{number}")
        made = spark.read.parquet(f"{tmp_path}/{number}")
        if name == "best_fit_packing":
            bins, lengths = collections.defaultdict(list), collections.Counter()
            for r in made.collect():
                bins[r.bin_id].append(r)
                lengths[r.doc_id] += r.length
            expected = collections.Counter()
            for key, text in before.elements():
                expected[key] += len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1
            assert lengths == expected
            assert all(sum(r.length for r in b) <= b[0].bin_size and b[0].bin_size in packing.CAPACITIES for b in bins.values())
            packed = collections.Counter(map(tuple, made.collect()))
            break
        assert made.columns == source.columns
        after = pairs(made)
        if name == "toxicity":
            kept = not_toxic(spark, before, docs, tmp_path)
            counts = collections.Counter()
            for (key, _), n in after.items():
                counts[key] += n
            assert not after - before and dict(+counts) == {k: n for k, n in kept.items() if n}
        elif name == "exact_dedup":
            squeezed = collections.Counter()
            for (key, text), n in after.items():
                squeezed[key, re.sub(r"[\x20\x09-\x0D]+", " ", text or "")] += n
            assert not after - before and squeezed == brute_copies(before) and after.total() < before.total()
        elif name == "simhash_near_dedup":
            classes = near_classes(before)
            assert not after - before and after.total() == len(classes) < before.total()
            for members in classes:
                chosen = [row for row in set(members) if after[row]]
                assert len(chosen) == 1 and chosen[0][0] == least(k for k, _ in members)
        else:
            assert after == brute_passages(before) and after != before
            assert all(r.n_chars == len(r.text) for r in made.collect())
        docs = made
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(map(tuple, run.collect())) == packed


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_run_without_texts(spark, tmp_path, rows):
    """No documents give no rows; a document without text is one item, its end mark."""
    docs = spark.createDataFrame(rows, tables(spark, "documents").schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tables(spark, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.length) for r in got] == [(None, 1)] * len(rows)
