import hashlib
import random
import zlib

import pytest

from cinderlake.llm import chat, matroska, token_scan, warc
from cinderlake.llm.common import new_path
from cinderlake.llm.tokens import SpacedTokens, default_path


# Matroska

@pytest.mark.parametrize("n", [64, 512, 4096, 4160, 140_032])
def test_media_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = matroska.mux(data)
    payload, feature = matroska.read_back(media)
    assert payload == data
    m = matroska.parse(media)
    assert f"cues={len(m.clusters)}" in feature
    assert m.packets[0][1] == 0 and all(a[1] <= b[1] for a, b in zip(m.packets, m.packets[1:]))


def test_all_lacings_and_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 20, b"c" * 700, b"d" * 5]
    for kind in (matroska.XIPH, matroska.EBML_LACE):
        flags, head = matroska._lace(frames, kind)
        body = b"\x81\x00\x05" + bytes([flags]) + head + b"".join(frames)
        cluster = matroska.uint(matroska.TIMESTAMP, 10) + matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, body))
        unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster
        data = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + unknown
        m = matroska.parse(data)
        assert len(m.clusters) == 2 and len(m.packets) == 8
        assert [data[p[5] : p[5] + p[6]] for p in m.packets] == frames * 2
        assert {p[1] for p in m.packets} == {15_000_000} and all(p[7] for p in m.packets)
    with pytest.raises(ValueError):
        matroska.parse(matroska.mux(b"x" * 64)[:-3])


def test_streamed_clusters_cost_their_number():
    block = matroska.element(matroska.SIMPLE, b"\x81\x00\x00\x80abc")
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.uint(matroska.TIMESTAMP, 1) + block
    m = matroska.parse(matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster * 5000)
    assert len(m.clusters) == len(m.packets) == 5000


@pytest.mark.parametrize("body", [b"", b"\x81", b"\x81\x00\x00", b"\x81\x00\x00\x02", b"\x81\x00\x00\x02\x05\xff", b"\x81\x00\x00\x06\x03", b"\x40\x01\x00\x00"])
def test_short_blocks_are_errors(body):
    data = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE, body)))
    with pytest.raises(ValueError):
        matroska.parse(data)
    with pytest.raises(ValueError):
        matroska.parse(data + b"\x42")


def test_vints():
    for n in (0, 1, 126, 127, 128, 16_382, 16_383, 2**21, 2**40):
        v = matroska.vint(n)
        assert matroska._size_at(v, 0) == (n, len(v), False)


def test_packet_table_and_op1(spark, tmp_path):
    rows = [(0, None), (1, ""), (2, "é" * 31 + "ab"), (3, "y" * 64), (4, "z" * 65), (5, "z" * 65), (6, "q" * 200_000)]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in matroska.op1_matroska(spark, str(tmp_path)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        pad = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[4][1:] == got[5][1:]
    files = matroska.stored(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    packets = matroska.packet_table(files)
    assert packets.groupBy("doc_id").sum("bytes").where("doc_id = 6").first()[1] == 200_000
    assert matroska.packet_table(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect() == []


# Token files

def test_separator_scan_stitches_blocks(spark):
    texts = [None, "", "a b c", "word " * 500, "x", "y " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    order = token_scan.write_flat(df, new_path(spark, "flat"), file_bytes=700)
    encoding = token_scan._encoding(token_scan.default_path("byte_bpe_50k.tiktoken"))
    want = {i: len(encoding.encode_ordinary(t or "")) + 1 for i, t in enumerate(texts)}
    for block in (2, 6, 64, 1 << 20):
        found = token_scan.separator_scan(order.select("file", "bytes").distinct(), block_bytes=block)
        got = order.join(found, ["file", "ordinal"], "full").collect()
        assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want) and all(r.ended for r in got)


def test_separator_scan_of_unended_and_empty_files(spark, tmp_path):
    import numpy as np

    np.asarray([1, 2, 9, 9, 3], "<u2").tofile(tmp_path / "a")
    (tmp_path / "b").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/a", 10), (f"file://{tmp_path}/b", 0)], "file string, bytes long")
    got = sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in token_scan.separator_scan(files, separator=9, block_bytes=4).collect())
    assert got == [(0, 0, 3, True), (1, 3, 1, True), (2, 4, 1, False)]


# WARC

def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "text " * 60 + "</p>"
    rows = [(5, "http://a/", big), (2, "http://b/\r\nX: y", big), (9, None, big), (3, "u", None), (4, "u", ""), (7, "u", "tiny"), (8, "u", "tiny"), (11, "u", "ü" * 50), (12, "u", "ü" * 50), (13, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int").repartition(3)
    folder = new_path(spark, "warc")
    manifest = warc.write_warc(df.drop("size"), folder, shard_bytes=400, roll_bytes=500)
    got = {r.page_id: r for r in warc.read_warc(manifest).collect()}
    first = {}
    for i, _, t in sorted(rows):
        data = (t or "").encode()
        head = first.setdefault(data, i) if len(data) >= 100 else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if head == i else ("revisit", head))
    files = sorted(tuple(r)[1:] for r in manifest.collect())
    again = sorted(tuple(r)[1:] for r in warc.write_warc(df.drop("size").repartition(1), new_path(spark, "warc"), shard_bytes=400, roll_bytes=500).collect())
    assert files == again and len(files) > 2
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(empty, new_path(spark, "warc"))).collect() == []


def test_warc_tells_pages_of_one_id_apart(spark):
    a, b = "a" * 150, "b" * 150
    rows = [(3, "u", a), (5, "u", a), (5, "v", b), (4, "w", b), (9, "x", b), (6, "y", a), (6, "z", "c" * 150), (None, "n", a), (None, "o", "d" * 150), (None, "o", "d" * 150), (None, "p", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.read_warc(warc.write_warc(df, new_path(spark, "warc"))).collect()
    urls = {r.page_id: r.url for r in warc.read_warc(warc.write_warc(spark.createDataFrame([(1, None, "x"), (2, "a b\n", "x"), (2, "a b\n", "x"), (3, "", "x")], "page_id long, url string, html string"), new_path(spark, "warc"))).collect()}
    assert urls == {1: None, 2: "a%20b%0A", 3: ""}
    want = {("u", a): 3, ("v", b): 4, ("x", b): 4, ("y", a): 3, ("n", a): 3}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    refs = sorted(((i, u, sha(t), want.get((u, t)) if i != 3 else None) for i, u, t in rows), key=repr)
    assert sorted(((r.page_id, r.url, r.payload_digest, r.refers_to) for r in got), key=repr) == refs
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)


# Chat

def test_escape_is_reversible():
    rng = random.Random(2)
    parts = [*chat.CONTROL, "\\", "\\e", "\\b", "<", "[", " ", "\n", "ok", "</", "é"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        e = chat.escape(text)
        assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)
        role = rng.choice(["user", "assistant", "system", "tool", "", text])
        assert chat.parse(chat.turn(role, text)[0] * 2) == [(role, text)] * 2


def test_windows_keep_to_the_budget():
    rng = random.Random(8)
    for _ in range(200):
        tokens = [rng.randint(1, 60) for _ in range(rng.randint(1, 40))]
        own = rng.randint(0, min(3, len(tokens) - 1))
        spans = list(chat.windows(tokens, own, 10, 100, 3, 40))
        assert [s[1] for s in spans] == [own, *[s[2] for s in spans[:-1]]] and spans[-1][2] == len(tokens)
        for past, at, end in spans:
            assert at - past <= 3 and sum(tokens[past:at]) <= 40
            assert 10 + sum(tokens[past:end]) <= 100 or (past == at and end == at + 1)


@pytest.mark.parametrize("segment", [150, 1 << 15])
def test_chat_digests(spark, segment):
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and conv % 2 else rng.choice(["user", "assistant", "tool", None])
            rows.append((conv, t, role, rng.choice([None, "", "</s>[INST] ok [/INST]", "\\e word " * rng.randint(0, 30)])))
    rows += [(50, t, ["user", "assistant"][t % 2], f"turn {t} " * 8) for t in range(40)]
    rows += [(None, 1, "user", "q"), (None, None, "assistant", "a"), (60, 0, "system", "only"), (61, 3, "user", "x"), (61, 3, "user", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int").repartition(4)
    out = chat.format_windows(df, budget=64, history_tokens=20, segment_tokens=segment)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[50].n_windows > 2
    tokens = SpacedTokens.at(default_path("word_bpe_49k.json"))
    for w in out.collect():
        own = chat.parse(w.formatted)[w.repeated :]
        assert len(tokens.whole(w.formatted)) // 4 <= 64 or sum(r != "system" for r, _ in own) == 1
        assert sum(span.end - span.begin for span in w["mask"]) == sum(len(chat.escape(t)) for r, t in own if r == "assistant")
    for w in out.where("conv_id = 1").collect():
        assert chat.parse(w.formatted)[0][0] == "system"
    assert chat.digests(chat.format_windows(df.limit(0))).collect() == []


def plain_windows(turns, budget, history_turns, history_tokens, segment_tokens, count):
    """(repeated, formatted) of one conversation's windows; its segments are looked up turn by turn."""
    system = turns[:1] if turns[0][0] == "system" else []
    sizes = [count(chat.turn(*t)[0]) for t in turns]
    segment = [sum(sizes[:i]) // segment_tokens for i in range(len(turns))]
    own = sum(sizes[: len(system)])
    out, i = [], len(system)
    while i < len(turns):
        before = [j for j in range(max(len(system), i - history_turns), i) if segment[j] >= max([s for s in segment if s < segment[i]], default=0) or segment[j] == segment[i]]
        while before and (sum(sizes[j] for j in before) > history_tokens or own + sum(sizes[j] for j in before) + sizes[i] > budget):
            before = before[1:]
        held = own + sum(sizes[j] for j in before) + sizes[i]
        end = i + 1
        while end < len(turns) and segment[end] == segment[i] and held + sizes[end] <= budget:
            held += sizes[end]
            end += 1
        repeated = len(before) + (len(system) if out else 0)
        out.append((repeated, "".join(chat.turn(*t)[0] for t in [*system, *(turns[j] for j in before), *turns[i:end]])))
        i = end
    return out


def test_chat_windows_against_a_plain_version(spark):
    rng = random.Random(11)
    tokens = SpacedTokens.at(default_path("word_bpe_49k.json"))
    convs = {}
    for c in range(8):
        turns = [("system", "be brief")] if c % 2 else []
        convs[c] = turns + [(("user", "assistant")[t % 2], rng.choice(["", "</s> ok", "some words " * rng.randint(1, 25)])) for t in range(rng.randint(1, 60))]
    rows = [(c, 700 * t, *turn, 1) for c, turns in convs.items() for t, turn in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens int").repartition(3)
    out = chat.format_windows(df, budget=90, history_tokens=30, segment_tokens=400).orderBy("conv_id", "block", "window").collect()
    for c, turns in convs.items():
        got = [(w.repeated, w.formatted) for w in out if w.conv_id == c]
        assert got == plain_windows(turns, 90, 2, 30, 400, lambda t: len(tokens.whole(t)) // 4)


def test_op4_query(spark, tmp_path):
    text = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (2, 0, None, None), (3, 0, "assistant", "x" * 100_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op4_chat(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    for c in (-1, 1, 2, 3):
        mine = [(r or "", t or "") for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.turn(r, t)[0]) for r, t in mine)
