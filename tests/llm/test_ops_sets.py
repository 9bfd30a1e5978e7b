"""Tool calls, top-k, near and exact duplicates, passages and the pipeline against brute force."""

import hashlib
import json
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from echograin.llm import ball_tree, chat, components, exact_dedup, passages, pii, queries, simhash
from echograin.llm.tokens import public


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


# op3 ----------------------------------------------------------------------------


def call(i, after=(), name="f", arguments=None):
    return {"id": i, "name": name, "arguments": arguments or {}, "after": list(after)}


SCHEMA = {"f": {"type": "object", "properties": {"x": {"type": "integer", "maximum": 0}}}}


@pytest.fixture(scope="module")
def talk(spark):
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call("a", ["b", "zz"]), call("b"), call("d", ["a", "b"], arguments={"y": "q", "x": 1.0})]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": 2.0}})),
        (1, 2, "tool", json.dumps({"tool_call_id": "nope", "content": 1})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": 3})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("a", ["b"]), call("b", ["a"]), call("e", ["a"]), call("a"), call("g", name="h")]})),
        (None, 0, "user", None),
        (None, 1, "user", '{"tool_calls": bad'),
        (3, None, None, '{"x":1}'),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("local", [10_000, 1])
def test_linking(talk, local):
    got = {(r["conv_id"], r["turn"], r["part"], r["kind"]): r for r in chat.link(talk, SCHEMA, local).collect()}
    assert len(got) == 14
    at = lambda *k: (got[k]["level"], got[k]["status"])
    assert [at(1, 0, k, "call") for k in range(3)] == [(1, "ok"), (0, "unanswered"), (2, "unanswered")]
    assert [at(2, 0, k, "call") for k in range(5)] == [(-1, "cyclic"), (-1, "cyclic"), (-1, "cyclic"), (None, "duplicate"), (0, "unanswered")]
    assert [got[1, k, 0, "result"]["status"] for k in (1, 2, 3)] == ["ok", "orphan", "duplicate"]
    assert json.loads(got[1, 0, 2, "call"]["json"])["faults"] == ["$.x: too large"]
    assert json.loads(got[2, 0, 4, "call"]["json"])["faults"] == ["unknown tool"]
    assert got[1, 1, 0, "result"]["json"] == '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"a"}'
    assert chat.link(talk.where("false"), SCHEMA, local).count() == 0


def test_malformed_messages_are_plain(spark):
    deep = "[" * 3000 + "]" * 3000
    some = "[" * 150 + "]" * 150
    texts = [
        ("assistant", '{"tool_calls": [{"id": "a", "arguments": ' + deep + "}]}", "message"),
        ("tool", '{"tool_call_id": "a", "content": ' + deep + "}", "message"),
        ("assistant", json.dumps({"tool_calls": [{"id": "b", "name": "f", "arguments": deep}]}), "call"),
        ("assistant", json.dumps({"tool_calls": [{"id": "c", "name": "f", "arguments": some}]}), "call"),
        ("assistant", '{"tool_calls": [{"id": "\\ud800", "name": "\\ud801", "arguments": {"\\udc00": "\\udfff"}}]}', "call"),
        ("tool", '{"tool_call_id": "\\ud800", "content": "\\ud800 x"}', "result"),
        ("assistant", json.dumps({"tool_calls": [{"id": "d", "name": "g", "after": 5}]}), "call"),
        ("assistant", json.dumps({"tool_calls": [{"id": "e", "name": "h", "after": True, "arguments": {"s": "x"}}]}), "call"),
        ("assistant", json.dumps({"tool_calls": [{"id": "f", "name": None, "after": [1, "e", None], "arguments": None}]}), "call"),
        ("assistant", '{"tool_calls": {}}', "message"),
        ("assistant", '{"tool_calls": [{"id": 7}]}', "message"),
    ]
    rows = [(1, i, role, text) for i, (role, text, _) in enumerate(texts)]
    schemas = {"f": {}, "g": {"type": ["strange", "object"]}, "h": {"type": "object", "properties": {"s": {"type": "text"}}}}
    got = {r["turn"]: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    assert [got[i]["kind"] for i in range(len(texts))] == [k for *_, k in texts]
    assert json.loads(got[2]["json"])["arguments"] == deep and json.loads(got[3]["json"])["arguments"] == json.loads(some)
    assert got[4]["call_id"] == got[5]["call_id"] == "\ufffd" and json.loads(got[4]["json"])["result"] == "\ufffd x"
    assert json.loads(got[7]["json"])["faults"] == ["$.s: not text"]
    assert json.loads(got[6]["json"])["faults"] == [] and got[8]["level"] == 1
    assert chat.faults("x", {"pattern": "("}) == ["$: no match"]


def test_levels_in_rounds(spark):
    """Chains, meeting chains, cycles and what lies behind them, against one task per conversation."""
    rng = random.Random(5)
    rows = [("chain", f"c{i}", [f"c{i - 1}"] if i else []) for i in range(60)]
    rows += [("ladder", f"{s}{i}", [f"a{i - 1}", f"b{i - 1}"][: 2 if i else 0] if s == "a" else [f"a{i}"]) for i in range(6) for s in "ab"]
    rows += [("cycle", f"c{i}", [f"c{(i + 1) % 5}"]) for i in range(5)] + [("cycle", "behind", ["c2", "free"]), ("cycle", "free", []), ("cycle", "own", ["own"])]
    for g in range(6):
        rows += [(f"random{g}", f"n{i}", [f"n{rng.randrange(30)}" if g % 2 else f"n{rng.randrange(i)}" for _ in range(rng.randrange(3)) if i]) for i in range(30)]
    calls = spark.createDataFrame(rows, "conv string, call_id string, after array<string>")
    one, many = ({(r["conv"], r["call_id"]): r["level"] for r in chat.levels(calls, n).collect()} for n in (10_000, 0))
    assert one == many and one["chain", "c59"] == 59 and one["cycle", "behind"] == -1 and len(one) == len(rows)


@settings(max_examples=200)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8))
def test_canonical_json_is_stable(value):
    line = chat.canonical(value)
    assert json.loads(line) == value and chat.canonical(json.loads(line)) == line


def test_turns_as_calls(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    got = chat.link(chat.turns_as_calls(conv), queries.ANSWER)
    assert got.count() == conv.count()
    turns = {(r["conv_id"], r["turn"]): r for r in conv.collect()}
    for r in got.where("kind = 'call'").collect():
        reply = turns.get((r["conv_id"], r["turn"] + 1))
        answered = reply is not None and reply["role"] == "assistant"
        assert json.loads(r["json"]).get("result") == (reply["text"] if answered else None)


def test_odd_turns(spark):
    conv = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", None), (5, None, "user", "x"), (5, 1, None, None), (6, 0, "user", ""), (6, 0, "user", ""), (6, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = chat.link(chat.turns_as_calls(conv), queries.ANSWER)
    assert got.count() == 7
    assert sorted(r["status"] for r in got.where("conv_id = 6").collect()) == ["duplicate", "invalid", "ok"]
    assert chat.link(chat.turns_as_calls(conv.where("false")), queries.ANSWER).count() == 0


# op4 ----------------------------------------------------------------------------


@pytest.mark.parametrize("shard,block", [(8192, 4096), (60, 7)])
def test_top_k(spark, sf, shard, block):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {tuple(r) for r in ball_tree.top_k(e, shard=shard, block=block).collect()}
    pdf = e.toPandas()
    q, ids = np.floor(64 * np.stack(pdf.embedding).astype(float)), pdf.vec_id.to_numpy()
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        scores = q @ q[i]
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:20]
        want |= {(int(ids[i]), k + 1, int(ids[j]), int(scores[j])) for k, j in enumerate(best)}
    assert got == want


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 2), (20, None, 3), (40, [1.0, None], 3), (None, [1.0, 1.0], 2), (60, [float("nan"), 1.0], 1), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, [1.0], 0), (100, [], 4)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    assert [tuple(r) for r in ball_tree.top_k(t).orderBy("rank").collect()] == [(0, 1, 1, 12288), (0, 2, 2, 12288)]
    assert ball_tree.top_k(t.where("false")).count() == 0


# op8 ----------------------------------------------------------------------------


def brute_mark(text, size):
    w = (text or "").encode().lower().split()
    shingles = [] if not w else [b" ".join(w)] if len(w) < size else [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius,crowd", [(2, 1024), (2, 1), (7, 1)])
def test_simhash_components(docs, radius, crowd):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_components(docs, 3, radius, crowd).collect()}
    marks = {r["doc_id"]: brute_mark(r["text"], 3) for r in docs.collect()}
    links = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= radius]
    root = groups(links, marks)
    assert got == {k: (f"{m:016x}", root[k]) for k, m in marks.items()}


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicate_components(odd, 3, 2).collect()
    assert len(got) == 12
    zero = [r["component_id"] for r in got if r["fingerprint"] == "0" * 16]
    assert zero == [2] * 4
    assert simhash.near_duplicate_components(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and simhash.drop_near_duplicates(empty).count() == 0
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 5, 7, 8, 9}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = groups(links, {n for pair in links for n in pair})
    assert got == {k: v for k, v in want.items() if k != v}


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for copy in range(rng.randint(0, 2)):
            other = list(words)
            other[rng.randrange(300)] = "changed"
            rows.append((10 * k + copy + 1, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == {10 * k for k in range(60)}


def shingle_sets(rows):
    return {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in rows for w in [t.split()]}


def jaccard_groups(rows):
    """Groups by Jaccard similarity 0.8 of all pairs, compared one by one."""
    sets = shingle_sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return groups(links, sets)


def random_texts(rng, count):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return [[rng.choice(vocabulary) for _ in range(rng.randint(150, 900))] for _ in range(count)], vocabulary


def kept_by_brute_force(rows):
    return {k for k, root in jaccard_groups(rows).items() if k == root}


@pytest.mark.parametrize("kind", ["replaced", "appended", "truncated"])
def test_near_copies_are_all_found(spark, kind):
    rng = random.Random(kind)
    rows = []
    texts, vocabulary = random_texts(rng, 80)
    for k, words in enumerate(texts):
        share = rng.uniform(0.79, 0.9)
        if kind == "appended":
            other = words + ["new" + rng.choice(vocabulary) for _ in range(round(len(words) * (1 / share - 1)))]
        elif kind == "truncated":
            other = words[: round(len(words) * share)]
        else:
            other = list(words)
            for i in rng.sample(range(len(words)), round(len(words) * (1 - share) / 10)):
                other[i] = "new" + rng.choice(vocabulary)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    want = kept_by_brute_force(rows)
    assert 80 <= len(want) < 120
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_similar_texts_stay(spark):
    rng = random.Random(7)
    rows = []
    texts, vocabulary = random_texts(rng, 80)
    for k, words in enumerate(texts):
        other = list(words)
        for i in rng.sample(range(len(words)), round(len(words) * rng.uniform(0.026, 0.06))):
            other[i] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    want = kept_by_brute_force(rows)
    assert len(want) > 150
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_links_of_every_document_count(spark):
    """The blocks of B are moved against A, and C is B with an edit: C is near B only."""
    rng = random.Random(11)
    rows = []
    texts, vocabulary = random_texts(rng, 120)
    for k, words in enumerate(texts):
        size = max(6, len(words) // rng.randint(8, 24))
        blocks = [words[i : i + size] for i in range(0, len(words), size)]
        for _ in range(rng.randint(1, 3)):
            i, j = rng.sample(range(len(blocks)), 2)
            blocks[i], blocks[j] = blocks[j], blocks[i]
        moved = [w for b in blocks for w in b]
        edited = list(moved)
        for i in rng.sample(range(len(words)), round(len(words) * rng.uniform(0.012, 0.02))):
            edited[i] = rng.choice(vocabulary)
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(moved)), (3 * k + 2, " ".join(edited))]
    sets = shingle_sets(rows)
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert sum(near(a, a + 1) and near(a + 1, a + 2) and not near(a, a + 2) for a in range(0, 360, 3)) > 5
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == kept_by_brute_force(rows)


def test_pipeline_links_near_fingerprints(spark, monkeypatch):
    """What fingerprints alone find, by brute force; with equal ones of texts that aren't similar."""
    rng = random.Random(13)
    texts, vocabulary = random_texts(rng, 40)
    rows = []
    for k, words in enumerate(texts):
        words = (words * 20)[:3000] if k % 4 == 0 else words + texts[k - 1] + texts[k - 2]
        other = list(words)
        other[rng.randrange(len(words))] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    rows += [(1000 + k, " ".join(["spam"] * 60 + rng.sample(vocabulary, 12))) for k in range(4)]
    sets, marks = shingle_sets(rows), {k: brute_mark(t, 5) for k, t in rows}
    assert len({marks[1000 + k] for k in range(4)}) == 1
    near = [(a, b) for a in sets for b in sets if a < b and (marks[a] ^ marks[b]).bit_count() <= 2 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert 10 < len(near) < 40 and all(a % 2 == 0 and b == a + 1 for a, b in near)
    given, real, left = spark.createDataFrame(rows, "doc_id long, text string"), simhash._candidates, set()

    def none(*args):
        left.update((r["a"], r["b"]) for r in real(*args).collect())
        return real(*args).limit(0)

    monkeypatch.setattr(simhash, "_candidates", none)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, given, "")
    assert {r["doc_id"] for r in kept.collect()} == sets.keys() - {b for _, b in near}
    monkeypatch.undo()
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, given, "").collect()} == kept_by_brute_force(rows)
    nodes = {k: np.uint64(xxhash.xxh64_intdigest(np.unique(simhash.shingle_hashes(t.encode(), 5)).tobytes(), 42)).view(np.int64) for k, t in rows}
    assert left and not left & {tuple(sorted((nodes[a], nodes[b]))) for a, b in near}  # linked pairs aren't looked at again


# op9 ----------------------------------------------------------------------------


def brute_passages(rows, length):
    first, out = {}, []
    top = 1 << 63
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, top), d if d is not None else top)
    for d, t in rows:
        b, k = (t or "").encode(), d if d is not None else top
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [8, 50])
@pytest.mark.parametrize("small", [False, True])
def test_passages(spark, monkeypatch, length, small):
    rng = random.Random(length)
    base = "".join(rng.choice("abcdé ") for _ in range(300))
    rows = []
    for _ in range(60):
        kind, t = rng.random(), None
        if kind < 0.3:
            t = base[rng.randint(0, 100) : rng.randint(150, 300)]
        elif kind < 0.6:
            changed = list(base)
            for _ in range(rng.randint(1, 6)):
                changed[rng.randrange(300)] = rng.choice("xyz")
            t = "".join(changed)
        elif kind < 0.7:
            t = "a" * rng.randint(0, 150)
        elif kind < 0.9:
            t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        rows.append((None if rng.random() < 0.05 else rng.randint(0, 50), t))
    if small:
        monkeypatch.setattr(passages, "CHUNK", 2000)
        monkeypatch.setattr(passages, "TRANSFORM", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in passages.remove_repeats(df, length).collect()), key=str)
    assert got == brute_passages(rows, length)


def test_passages_odd(odd, empty):
    got = sorted((tuple(r) for r in passages.remove_repeats(odd).collect()), key=str)
    assert got == brute_passages([(r["doc_id"], r["text"]) for r in odd.collect()], 50)
    assert passages.remove_repeats(empty).count() == 0
    kept = passages.remove_repeats(odd, with_text=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 20))
def test_transform_finds_common_prefixes(symbols, length):
    text = np.array(symbols)
    order, short = passages.transform_prefixes(text, length)
    n = len(text)
    for i in range(1, n):
        common = 0
        while common < length and text[(order[i - 1] + common) % n] == text[(order[i] + common) % n]:
            common += 1
        assert bool(short[i]) == (common < length)


# op10 and the pipeline --------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(odd, empty, docs, keep):
    for df in (odd, docs, empty):
        got = exact_dedup.duplicate_groups(df, keep).collect()
        texts = {}
        for r in df.collect():
            texts.setdefault(r["text"] or "", []).append(r["doc_id"])
        assert len(got) == sum(map(len, texts.values()))
        best = {}
        for t, ids in texts.items():
            named = [i for i in ids if i is not None]
            best[hashlib.sha256(t.encode()).hexdigest()] = ((min if keep == "smallest" else max)(named) if named else None, len(ids))
        assert all((r["keep_id"], r["group_size"]) == best[r["text_sha256"]] for r in got)
        assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(best)
        kept = exact_dedup.drop_duplicates(df, keep)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((best[h][0] is None, best[h][0] or 0, t) for t in texts for h in [hashlib.sha256(t.encode()).hexdigest()])


def test_pipeline(spark, sf, docs, odd, empty):
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() > 0.8 * docs.select("text").distinct().count()
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert name == "packing" or out.columns == df.columns
            out.count()
    strange = odd.withColumns({"my col": F.lit(1), "a.b": F.lit("x"), "__row": F.lit(2), "s": F.struct(F.lit(1).alias("a-b"), F.lit("t").alias("c.d e"))})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, strange, sf)
        assert name == "packing" or out.columns == strange.columns
        out.count()
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.count() == docs.count()
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, odd, sf).collect()} == {1, None, 5, 6, 7, 9}


def test_pipeline_by_brute_force(spark, sf, docs):
    """Each stage on the stage before it, against plain Python."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(7)
    for i, (_, text) in enumerate(rows[:40]):
        words = text.split()
        if len(words) >= 60:
            at = rng.randrange(len(words))
            rows.append((100_000 + i, " ".join([*words[:at], "changed", *words[at + 1 :]])))
        rows += [(200_000 + i, text), (300_000 + i, "12 34 :: 56")]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    stage = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    kept = stage["language_id"](spark, given, sf)
    assert plain(kept) == sorted(r for r in rows if any(c.isalpha() for c in r[1]))

    least = {}
    for i, text in plain(kept):
        least.setdefault(text, i)
    exact = stage["exact_dedup"](spark, kept, sf)
    assert plain(exact) == sorted((i, t) for t, i in least.items())

    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().decode().split()) else set() for i, t in plain(exact)}
    group = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    near = stage["near_dedup"](spark, exact, sf)
    assert [i for i, _ in plain(near)] == sorted(set(group.values())) and len(set(group.values())) < len(ids)

    clean = stage["personal_data"](spark, near, sf)
    before, after = dict(plain(near)), dict(plain(clean))
    field = pii.train()
    for i, text in before.items():
        _, every = pii.spans_of([text], field)
        parts, at = [], 0
        for start, kind, end in every[0]:
            parts += [text[at:start], "<" + pii.KINDS[kind].upper() + ">"] if start >= at else []
            at = max(at, end)
        assert after[i] == "".join(parts) + text[at:]
    assert before != after and before.keys() == after.keys()

    encode = Tokenizer.from_file(public("word_bpe_49k.json")).encode
    want = sorted((i, k) for i, t in after.items() for k in range(-(-(len(encode(t, add_special_tokens=False).ids) + 1) // 2048)))
    packed = stage["packing"](spark, clean, sf).collect()
    assert sorted((r["doc_id"], r["piece"]) for r in packed) == want
