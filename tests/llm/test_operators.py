"""Odd rows, empty tables, forced hot groups and round trips of each operator."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import (
    chat, components, exact, packing, pieces, quality, rules, sharding, simhash, suffix, toxicity,
)

from .conftest import ODD, table
from .test_queries import brute_passages, brute_simhash


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---- pieces


def test_pieces_equal_the_library_on_random_texts():
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=model_path())
    model = pieces.PieceModel(pieces.read_model(model_path()))
    known = [library.id_to_piece(i) for i in range(259, 32_000)]
    draw = random.Random(7)
    for _ in range(4_000):
        text = draw.choice([
            lambda: "".join(draw.choice(" \n▁\tabé漢🙂\0<0x0A>") for _ in range(draw.randint(0, 40))),
            lambda: "".join(draw.choice(known) for _ in range(draw.randint(1, 12))),
            lambda: " " * draw.randint(0, 40) + "".join(draw.choice(known).replace("▁", " ") for _ in range(6)),
            lambda: "".join(draw.choice("aeinst") for _ in range(draw.randint(1, 40))),
        ])()
        ids = library.encode(text, add_eos=True)
        assert list(map(int, model.encode(text).split(" "))) == ids
        assert model.decode(" ".join(map(str, ids))) == library.decode(ids)
        some = [draw.randint(0, 300) for _ in range(6)]
        assert model.decode(" ".join(map(str, some))) == library.decode(some)


def test_pieces_long_runs_without_joined_neighbours():
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=model_path())
    model = pieces.PieceModel(pieces.read_model(model_path()))
    draw = random.Random(8)
    for text in (
        "".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(10_000)),
        "".join(draw.choice("0123456789") for _ in range(10_000)),
        "a  b" + "\n".join(draw.choice(["tree", "stone", "x"]) for _ in range(10_000)),
        "\n" * 5_000 + "\t" * 5_000,
    ):
        ids = library.encode(text, add_eos=True)
        assert list(map(int, model.encode(text).split(" "))) == ids
        assert model.decode(" ".join(map(str, ids))) == library.decode(ids)


def test_pieces_odd_rows(spark, odd, empty):
    both = pieces.with_text(pieces.with_ids(odd, model_path()), model_path())
    for r in both.select("text", "token_ids", "decoded").collect():
        assert r.token_ids[-1] == 2
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.digests(odd, model_path()).count() == len(ODD)
    assert pieces.digests(empty, model_path()).count() == 0


# ---- exact copies


def expected_groups(documents):
    import re

    groups = collections.defaultdict(list)
    for key, text in documents:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    return groups


def test_exact_groups(spark, odd, empty):
    groups = expected_groups(ODD)
    got = exact.exact_groups(odd).collect()
    by_text = collections.defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    assert len(got) == len(ODD) and len(by_text) == len(groups)
    for text, keys in groups.items():
        members = by_text[hashlib.sha256(text.encode()).hexdigest()]
        least = min((k for k in keys if k is not None), default=None)
        assert sorted(str(r.doc_id) for r in members) == sorted(map(str, keys))
        assert {(r.keep_id, r.group_size) for r in members} == {(least, len(keys))}
        assert [r.doc_id for r in members if r.kept] == [least]
    assert exact.exact_groups(empty).count() == 0


def test_drop_copies(spark, odd, empty):
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        min(k for k in keys if k is not None) for keys in expected_groups(ODD).values())
    assert exact.drop_copies(empty).count() == 0


# ---- near copies


def brute_components(documents, radius=4):
    prints = [brute_simhash(t) for _, t in documents]
    label = list(range(len(documents)))
    for i in range(len(documents)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (key, _), x in zip(documents, label):
        if key is not None:
            least[x] = min(least.get(x, key), key)
    return sorted((str(key), f"{p:016x}", least.get(x)) for (key, _), p, x in zip(documents, prints, label))


def test_simhash_odd_rows(spark, odd, empty):
    got = simhash.near_groups(odd).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute_components(ODD)
    assert simhash.near_groups(empty).count() == 0
    assert simhash.drop_near(odd).columns == odd.columns


def test_drop_near_keeps_one_row_of_each_component(spark):
    """Repeated and null keys with differing texts: every component keeps one row, the right one."""
    draw = random.Random(9)
    long = [" ".join(str(draw.random()) for _ in range(300)) for _ in range(12)]
    near = [t + " end" for t in long]
    documents = [(1, long[0]), (5, near[0]), (5, long[1]), (5, long[2])]  # a near copy, two texts of their own
    documents += [(7, long[3]), (7, near[3]), (None, long[3]), (7, long[3])]  # one component, smallest key repeated
    documents += [(None, long[4]), (None, near[4]), (None, long[5])]  # null keys only
    documents += [(8, None), (9, ""), (8, None), (None, " ")]
    documents += [(40, t) for t in long[6:9]] + [(40, t) for t in near[6:9]] + [(41, long[6]), (39, near[7])]
    groups = collections.defaultdict(list)
    prints = [brute_simhash(t) for _, t in documents]
    label = list(range(len(documents)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if bin(a ^ b).count("1") <= 4:
                label = [label[j] if x == label[i] else x for x in label]
    for x, row in zip(label, documents):
        groups[x].append(row)
    assert len(groups) < len(documents)
    kept = collections.Counter((r.doc_id, r.text or "") for r in simhash.drop_near(table(spark, documents)).collect())
    assert sum(kept.values()) == len(groups)
    for members in groups.values():
        inside = [(k, t or "") for k, t in members]
        chosen = [row for row in set(inside) if kept[row]]
        assert len(chosen) == 1 and kept[chosen[0]] == 1
        assert chosen[0][0] == min((k for k, _ in inside if k is not None), default=None)


def test_large_shards_in_pieces_lose_no_link(spark, monkeypatch):
    """Clusters of fingerprints far over the size of a piece give the components of brute force."""
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 2**63, 5, dtype=np.int64)
    fps = set()
    for centre in centres.tolist():
        for _ in range(120):
            flipped = centre
            for bit in draw.integers(0, 63, draw.integers(0, 9)).tolist():
                flipped ^= 1 << bit
            fps.add(flipped)
    fps |= set(draw.integers(0, 2**63, 200, dtype=np.int64).tolist())
    known = sorted(fps)
    monkeypatch.setattr(simhash, "PIECE", 16)
    frame = spark.createDataFrame([(f,) for f in known], "fp long")
    linked = components.components(simhash.links(simhash.shards(frame)))
    got = {r.node: r.root for r in linked.collect()}
    label = {f: f for f in known}
    for i, a in enumerate(known):
        for b in known[:i]:
            if bin(a ^ b).count("1") <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {f: low if x == high else x for f, x in label.items()}
    assert {f: got.get(f, f) for f in known} == label


def test_search_tree_equals_brute_force():
    draw = np.random.default_rng(4)
    centre = np.uint64(draw.integers(0, 2**63))
    members = np.unique(np.array([int(centre) ^ sum(1 << int(b) for b in set(draw.integers(0, 64, 6))) for _ in range(900)], np.uint64))
    found = simhash._Search(members, 4).label
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= 4
    label = np.arange(len(members))
    while True:
        new = np.where(near, label[None, :], len(members)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert len(np.unique(found)) == len(np.unique(label))
    assert len(np.unique(np.stack([found, label]), axis=1).T) == len(np.unique(label))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (None, 5), (9, None)]
    got = components.components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == {
        **{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- passages


@pytest.mark.parametrize("small", [{}, {"shard_bytes": 700, "anchor_bytes": 500, "stretch_bytes": 300, "frequent": 2}])
def test_passages_odd_rows(spark, odd, empty, small):
    documents = [(k, (t or "").encode()[:4000]) for k, t in ODD]
    frame = table(spark, [(k, t.decode()) for k, t in documents])
    got = suffix.passage_report(frame, **small).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_passages(documents)))
    assert suffix.passage_report(empty, **small).count() == 0


def test_passages_with_many_buckets(spark, monkeypatch):
    """More than 2^16 anchor buckets, and more table buckets than shuffle partitions."""
    monkeypatch.setattr(suffix, "TABLE_BYTES", 1 << 12)
    rng = np.random.default_rng(4)
    words = [f"w{rng.integers(1 << 40):x}" for _ in range(3000)]
    documents = [(i, " ".join(words[i * 100 : i * 100 + 1000])) for i in range(8)]
    documents = [(i, t[: 9000 + 37 * i]) for i, t in documents]
    assert sum(len(t) for _, t in documents) > 1 << 16
    got = suffix.passage_report(table(spark, documents).select("doc_id", "text"), shard_bytes=4000, anchor_bytes=1)
    expected = brute_passages([(i, t.encode()) for i, t in documents])
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_passages_cut_characters(spark):
    shared = "é" * 40
    frame = table(spark, [(1, "a" + shared), (2, "ab" + shared + "é" + "é"), (3, None)])
    dropped = suffix.drop_passages(frame)
    assert dropped.columns == frame.columns
    got = {r.doc_id: r for r in dropped.collect()}
    assert got[1].text == "a" + shared and got[3].text == ""
    assert all(got[i].n_chars == len(got[i].text) for i in got)


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(5)
    for alphabet, size in ((2, 400), (3, 1_000), (1, 200)):
        text = draw.integers(97, 97 + alphabet, size).astype(np.uint8)
        order = suffix.suffix_array(text, 50)
        raw = text.tobytes()
        cut = [raw[i : i + 50].ljust(50, b"\0") for i in order.tolist()]
        assert cut == sorted(cut) and sorted(order.tolist()) == list(range(size))
        shared = suffix.common_prefixes(text, order, np.array([0, size // 2]), 50)
        for a, b, n in zip(cut, cut[1:], shared[1:].tolist()):
            assert n == next((i for i in range(50) if a[i] != b[i]), 50)


# ---- sharding


def test_sharding_small_limit(spark, odd, empty):
    for limit in (1, 64, 300, 10_000):
        got = sharding.shard_directory(odd, limit).collect()
        assert len(got) == len(ODD)
        shards = collections.defaultdict(list)
        for r in got:
            shards[r.shard].append(r)
        names = sorted(s.split(".")[0] for s in shards)
        assert not any(b != a and b.startswith(a) for a, b in zip(names, names[1:]))
        for inside in shards.values():
            total = sum(r.n_bytes for r in inside)
            assert {(r.shard_bytes, r.shard_docs) for r in inside} == {(total, len(inside))}
            assert total <= limit or len(inside) == 1
    assert sharding.shard_directory(empty, 10).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_directory(odd, 0)


def test_written_shards(spark, tmp_path):
    frame = spark.createDataFrame([(i, "x" * 50) for i in range(60)], "doc_id long, text string")
    sharding.write_shards(frame, f"{tmp_path}/out", 400)
    back = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out")
    assert back.count() == 60
    assert max(r.n for r in back.groupBy("shard_name").agg(F.sum(F.length("text")).alias("n")).collect()) <= 400


def test_written_shards_hold_null_and_repeated_keys_once(spark, odd, tmp_path):
    directory = sharding.write_shards(odd, f"{tmp_path}/out", 300)
    back = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in back))) == sorted(map(str, ODD))
    written = collections.Counter((r.shard_name, r.doc_id, len((r.text or "").encode())) for r in back)
    assert written == collections.Counter(("s" + r.shard, r.doc_id, r.n_bytes) for r in directory.collect())


def test_written_shards_and_clashing_names(spark, tmp_path):
    frame = spark.createDataFrame(
        [(i, "x" * 50, "a", "b", 1) for i in range(20)], "`doc.id` long, `the text` string, shard_name string, _doc string, _key int")
    with pytest.raises(ValueError):
        sharding.write_shards(frame, f"{tmp_path}/none", 400, "doc.id", "the text")
    sharding.write_shards(frame, f"{tmp_path}/out", 400, "doc.id", "the text", folder="part_of")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.drop("part_of").columns == frame.columns
    assert sorted(map(tuple, back.drop("part_of").collect())) == sorted(map(tuple, frame.collect()))


def test_sharding_fills_pages_of_a_repeated_key(spark):
    rows = [(7, "x" * 10)] * 95 + [(7, "y" * 70), (7, None), (7, ""), (None, "z" * 40), (None, "z" * 30)] + [(i, "u" * 9) for i in range(50)]
    got = sharding.shard_directory(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()
    assert collections.Counter((r.doc_id, r.n_bytes) for r in got) == collections.Counter((i, len(t or "")) for i, t in rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for inside in shards.values():
        total = sum(r.n_bytes for r in inside)
        assert {(r.shard_bytes, r.shard_docs) for r in inside} == {(total, len(inside))}
        assert total <= 64 or len(inside) == 1
    tens = {r.shard for r in got if (r.doc_id, r.n_bytes) == (7, 10)}
    assert len(tens) == 16


@pytest.mark.parametrize("limit", [40, 500])
def test_sharding_splits_only_oversized_buckets(spark, limit):
    """Against the directory grown bucket by bucket, with one row far larger than the rest."""
    rows = [(i, "x" * (i * 37 % 29)) for i in range(300)] + [(900, "y" * 4000)]
    hashes = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _ in rows}
    size = {i: len(t) for i, t in rows}
    expected, open_buckets = {}, [("", list(size))]
    while open_buckets:
        prefix, inside = open_buckets.pop()
        total = sum(size[i] for i in inside)
        if total <= limit or len(inside) == 1:
            expected |= {i: (prefix, len(prefix), size[i], total, len(inside)) for i in inside}
            continue
        for bit in "01":
            half = [i for i in inside if format(hashes[i], "060b")[len(prefix)] == bit]
            if half:
                open_buckets.append((prefix + bit, half))
    got = sharding.shard_directory(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == expected and len(got) == len(rows)


# ---- packing


@pytest.mark.parametrize("hot", [7, None])
def test_packing_spreads_a_hot_key(spark, monkeypatch, hot):
    """A third of all rows under one id, or under none: no group holds more than the others."""
    monkeypatch.setattr(packing, "NUMBERED", 16)
    rows = [(i, "w " * (i % 40)) for i in range(800)] + [(hot, "w " * 5)] * 400
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(frame, capacities=(16, 64), overhead=2, group_items=100).collect()
    assert collections.Counter((r.doc_id, r.length) for r in got) == collections.Counter((i, len(t.split()) + 1) for i, t in rows)
    groups = collections.Counter(r.bin_id % 12 for r in got)
    assert len(groups) == 12 and max(groups.values()) < 200
    again = packing.pack(frame.repartition(7), capacities=(16, 64), overhead=2, group_items=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_packing_odd_rows(spark, odd, empty):
    got = packing.pack(odd, capacities=(4, 16, 64), overhead=2, group_items=5).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    assert all(sum(r.length for r in b) <= b[0].bin_size for b in bins.values())
    assert sum(r.length for r in got) == sum(len((t or "").encode().split()) + 1 for _, t in ODD)
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, capacities=())


def test_packing_is_near_the_best(spark):
    """Never worse than 1.5 times the cheapest packing of a few items, and it shrinks its bins."""
    draw = random.Random(2)

    def best(items, sizes, overhead):
        cheapest = [float("inf")]

        def place(at, bins):
            if at == len(items):
                cheapest[0] = min(cheapest[0], sum(min(s for s in sizes if s >= b) + overhead for b in bins))
                return
            for i in range(len(bins)):
                if bins[i] + items[at] <= max(sizes):
                    place(at + 1, bins[:i] + [bins[i] + items[at]] + bins[i + 1 :])
            place(at + 1, bins + [items[at]])

        place(0, [])
        return cheapest[0]

    for _ in range(30):
        items = sorted((draw.randint(1, 16) for _ in range(7)), reverse=True)
        where, offset, size = packing.pack_group(np.array(items), (4, 8, 16), 1)
        used = {b: (s, sum(n for n, w in zip(items, where) if w == b)) for b, s in zip(where.tolist(), size.tolist())}
        assert all(n <= s and not any(n <= c < s for c in (4, 8, 16)) for s, n in used.values())
        assert sum(s + 1 for s, _ in used.values()) <= 1.5 * best(items, (4, 8, 16), 1)


# ---- chat


def test_layouts_round_trip(spark):
    import json

    marked = "<|end|></s>[INST] <\\s> <<SYS>> <|turn|> é"
    records = {
        1: {"messages": [{"role": "user", "content": marked}, {"role": "assistant", "content": "<\\\\s>"}]},
        2: {"prompt": "p", "completion": marked},
        3: {"system": "s", "prompt": "p", "response": "r"},
        4: {"instruction": "i", "input": "more", "output": "o"},
        5: {"instruction": "i", "output": None},
        6: {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        7: {"question": "q", "answer": ""},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()]
    rows += [(8, json.dumps({"turn": 1, "role": "assistant", "text": "b"})), (8, json.dumps({"turn": 0, "role": "user", "text": None}))]
    rows += [(9, '{"unknown": 1}'), (10, "no json"), (11, None)]
    frame = spark.createDataFrame(rows, "key long, record string")
    back = chat.read_back(chat.format_turns(chat.canonical_turns(frame)))
    got = {r.key: ([tuple(t) for t in r.turns], r.loss_text) for r in back.collect()}
    assert got == {
        1: ([("user", marked), ("assistant", "<\\\\s>")], "<\\\\s>"),
        2: ([("user", "p"), ("assistant", marked)], marked),
        3: ([("system", "s"), ("user", "p"), ("assistant", "r")], "r"),
        4: ([("user", "i\n\nmore"), ("assistant", "o")], "o"),
        5: ([("user", "i"), ("assistant", "")], ""),
        6: ([("user", "h"), ("assistant", "g")], "g"),
        7: ([("user", "q"), ("assistant", "")], ""),
        8: ([("user", ""), ("assistant", "b")], "b"),
    }
    assert sorted(r.key for r in chat.unmapped(frame).collect()) == [9, 10, 11]
    none = frame.where("false")
    assert chat.format_turns(chat.canonical_turns(none)).count() == 0


def test_turns_of_any_length_stay(spark, tmp_path):
    """A turn longer than a JSON string may be is formatted like any other."""
    from adlens.llm import queries

    rows = spark.createDataFrame(
        [(1, 0, "user", "ab"), (1, 1, "assistant", "c"), (2, 0, "assistant", "de"), (3, None, None, None)],
        "conv_id long, turn int, role string, text string")
    size = 21_000_000
    long = rows.withColumn("text", F.when(F.length("text") == 2, F.expr(f"repeat(text, {size // 2})")).otherwise(F.col("text")))
    long.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op8_chat_formatting(spark, str(tmp_path)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {-7: (2, 21), 1: (2, 1), 2: (1, size), 3: (1, 0)}
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\n" + b"de" * (size // 2) + b"\n").hexdigest()
    with pytest.raises(ValueError):
        chat.table_turns(rows, "conv_id", "turn", "role")


def test_tables_are_read_by_the_fingerprint_of_their_schema(spark):
    """Columns of any layout give the turns that the same rows give as JSON records."""
    frames = [
        (("messages",), "key long, messages array<struct<role:string,content:string>>, `_t` int",
         [(1, [("user", "u"), ("assistant", None)], 0), (2, None, 0), (3, [], 0)]),
        (("conversations",), "key long, conversations array<struct<value:string,from:string>>, `_t` int",
         [(1, [("a question", "human"), ("an answer", "gpt")], 0)]),
        (("instruction", "output", "input"), "key long, instruction string, input string, output string",
         [(1, "i", None, "o"), (2, "i", "more", None)]),
        (("question", "answer"), "key long, question string, answer int", [(1, "q", 4), (None, None, None)]),
        (("turn", "role", "text"), "key long, turn int, role string, text string", [(1, 0, "user", "x"), (1, None, None, None)]),
    ]
    for fields, kind, rows in frames:
        frame = spark.createDataFrame(rows, kind)
        sample = chat.as_records(frame.where(f"`{fields[0]}` is not null"), "key", *fields)
        full = sample.select(chat.shape(F.col("record"))).first()[0]
        assert full == chat.shape_of_type(frame.select(*fields).schema)
        direct = chat.table_turns(frame, "key", *fields)
        through = chat.canonical_turns(chat.as_records(frame.where("key is not null"), "key", *fields))
        assert direct.columns == through.columns
        known = sorted(map(str, direct.where("key is not null").collect()))
        assert set(map(str, through.collect())) <= set(known) and known
    odd = spark.createDataFrame([(1, [("u", "t", 1)])], "key long, messages array<struct<role:string,content:string,more:int>>")
    with pytest.raises(ValueError):
        chat.table_turns(odd, "key", "messages")


def test_records_with_very_long_strings_stay(spark):
    """A JSON string longer than the parser takes by default is read like any other."""
    size = 21_000_000
    record = F.concat(F.lit('{"prompt": "p", "completion": "'), F.expr(f"repeat('a', {size})"), F.lit('"}'))
    frame = spark.range(1).select(F.col("id").alias("key"), record.alias("record"))
    got = chat.canonical_turns(frame).select("role", F.length("text").alias("n")).collect()
    assert sorted(map(tuple, got)) == [("assistant", size), ("user", 1)]
    assert chat.unmapped(frame).count() == 0


def test_escaping_is_reversible(spark):
    draw = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "|end|>", "<|turn|>", "<<SYS>>", "</s>", "x"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


# ---- classifiers and rules


@pytest.mark.parametrize("apply", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_rows(spark, odd, empty, labels, apply):
    got = apply(odd, labels).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r.score <= 1 and r.held_out in (True, False) for r in got)
    assert apply(empty, labels).count() == 0
    assert len(apply(odd, labels.where("false")).collect()) == len(ODD)
    assert len(apply(odd, labels.withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(1))).collect()) == len(ODD)


def test_toxicity_grams_are_characters():
    """Every gram of 3 to 6 code points of a text once, and none across two texts."""
    texts = ["é漢🙂É漢🙂x", "", "ab", "漢字漢字漢字", "ÀB" * 40]
    owner, hashes = toxicity.presence(texts, None)
    for i, text in enumerate(texts):
        low = text.lower()
        grams = {low[a : a + n] for n in (3, 4, 5, 6) for a in range(len(low) - n + 1)}
        alone = {int(toxicity.presence([g], None)[1][0]) for g in grams if len(g) == 3}
        assert (owner == i).sum() == len(grams)
        assert alone <= set(hashes[owner == i].tolist())


def test_toxicity_learns_the_marked_words(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["tree", "stone", "river", "house"]) for _ in range(40)) + (" zzgrumpf vile" if i % 4 == 0 else "")) for i in range(400)]
    docs = table(spark, rows)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 300


def test_rules_on_odd_rows(spark, odd, empty, labels):
    got = rules.quality_rules(odd, labels).collect()
    assert len(got) == len(ODD)
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert rules.quality_rules(empty, labels).count() == 0


def test_rules_find_thresholds():
    import pandas as pd

    draw = np.random.default_rng(6)
    sample = pd.DataFrame({name: draw.random(3_000) for name in rules.STATISTICS})
    sample["good"] = ~((sample["symbols_per_word"] > 0.8) | ((sample["upper_share"] > 0.7) & (sample["n_words"] < 0.3)))
    found = rules.learn(sample)
    covered = np.zeros(len(sample), bool)
    values = {n: sample[n].to_numpy() for n in rules.STATISTICS}
    for rule in found:
        covered |= rules._covers(rule, values, len(sample))
    assert (covered != sample["good"].to_numpy()).mean() > 0.95
    assert rules.learn(sample.assign(good=True)) == []
