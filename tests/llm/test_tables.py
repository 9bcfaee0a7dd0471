import math
import random
import re
from collections import Counter

from tests.llm import brute

from palisade.llm import archive, chat, decontaminate, mixing, tokens
from palisade.llm.common import table

SF = "/root/testdata/sf0.001"
TOKEN_TEXTS = [None, "", " ", "a  b\n\n c\t", "it's we'll they'd 123abc", "<|endoftext|>x <|endoftext|> y<|endoftext|>", "é ñ 漢字 \U0001f600​ x y\x1c\x1fz\x85\xa0", "a" * 5000, "́é Ǆ ﻿", "का कि ำ 　 x"]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = [r.text for r in table(spark, SF, "documents").collect()] + TOKEN_TEXTS
    library = Tokenizer.from_file(tokens.vocabulary_path())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS piece", "1 AS row")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024), t


def test_token_counts_of_repeated_rows_and_rare_pieces(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD_ROWS", 2)
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "zebra"), (2, None)], "doc_id long, text string")
    assert sorted(((str(r.doc_id), r.n_tokens) for r in tokens.count_tokens(df).collect())) == [("1", 3), ("1", 3), ("2", 0), ("None", 2)]
    assert tokens.count_tokens(df.limit(0)).collect() == []


def test_poisson_counts():
    u = [k / 20000 for k in range(20000)]

    def plain(x, rate):
        k, term = 0, math.exp(-rate)
        below = term
        while x >= below and k < mixing.STEPS + 1:
            k += 1
            term *= rate / k
            below += term
        return k

    counts = [plain(x, 2.5) for x in u]
    assert abs(sum(counts) / len(counts) - 2.5) < 0.01


def test_mixing_reaches_its_targets(spark):
    from pyspark.sql import functions as F

    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, "big").when(F.col("id") < 29_000, "mid").alias("source"), F.lit("x").alias("mix_key"))
    mixed = mixing.replicated(docs, {"big": 1.0, "mid": 3.0})
    n = Counter(r.source for r in mixed.select("source").collect())
    assert abs(n["big"] - 7500) < 350 and abs(n["mid"] - 22500) < 600 and None not in n
    again = mixing.replicated(docs, {"big": 1.0, "mid": 3.0})
    assert mixed.select("doc_id", "mix_copy").collect() == again.select("doc_id", "mix_copy").collect()
    even = Counter(r.source for r in mixing.replicated(docs).select("source").collect())
    want = {s: 30_000 * math.sqrt(k) / (math.sqrt(20_000) + math.sqrt(9_000) + math.sqrt(1_000)) for s, k in (("big", 20_000), ("mid", 9_000), (None, 1_000))}
    assert all(abs(even[s] - w) < 5 * math.sqrt(w) for s, w in want.items())
    order = [r.mix_key for r in mixed.select("mix_key").collect()]
    assert order == sorted(order)
    assert mixing.replicated(docs.limit(0)).collect() == []
    steep = Counter(r.doc_id for r in mixing.replicated(docs.where("doc_id >= 29990"), epochs=50.0).select("doc_id").collect())
    assert 300 < sum(steep.values()) < 700


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, "a", "t"), (1, "a", "t"), (None, None, None)], "doc_id long, source string, text string")
    counts = Counter((r.doc_id, r.source) for r in mixing.replicated(df, epochs=3.0).collect())
    assert counts[1, "a"] % 2 == 0
    assert mixing.replicated(df).columns == ["doc_id", "source", "text", "mix_copy", "mix_key"]


def test_mixing_of_many_sources_and_clashing_names(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 7) AS source", "repeat('long text ', if(id = 5, 200000, 1)) AS text", "1 AS rate", "2 AS mix_rate", "3 AS mix_count", "4 AS document", "5 AS salt", "6 AS id", "7 AS n", "8 AS of")
    few = sorted(mixing.replicated(df, epochs=2.0).collect())
    assert {r.mix_rate for r in few} == {2} and few[0].asDict().keys() == {*df.columns, "mix_copy", "mix_key"}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 2)
    assert sorted(mixing.replicated(df, epochs=2.0).collect()) == few


def pages(spark):
    big = "<html>" + "é" * 600 + "</html>"
    rows = [(1, "http://a", big), (7, "http://b", big), (3, "http://c\r\nX: y", big), (4, None, "small"), (5, "http://e", "small"), (6, "http://f", None), (9, "http://g", "a\r\n\r\nb" * 400), (None, "http://h", big), (7, "http://b", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS address")


def test_archive_round_trip(spark):
    headers, payloads = archive.archive_pages(pages(spark))
    assert payloads.count() == 4 == payloads.select("address").distinct().count()
    read = archive.verified(archive.read_records(archive.rebuild_records(headers, payloads))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in read) == sorted(
        [("1", "revisit", 7), ("7", "response", None), ("7", "response", None), ("3", "revisit", 7), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("9", "response", None), ("None", "revisit", 7)]
    )
    html = {(r.page_id, r.html) for r in pages(spark).collect()}
    for r in read:
        if r.record_type == "response":
            assert any(p == r.page_id and (h or "").encode() == bytes(r.payload) for p, h in html)
    assert {r.payload_bytes for r in read if r.page_id in (1, 3, 7)} == {len(("<html>" + "é" * 600 + "</html>").encode())}


def test_archive_files_and_damage(spark, tmp_path):
    import gzip

    import pytest

    headers, payloads = archive.archive_pages(pages(spark))
    archive.export_warc(headers, payloads, str(tmp_path / "warc"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz"))
    seen = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert rest[n : n + 4] == b"\r\n\r\n"
        data, seen = rest[n + 4 :], seen + 1
    assert seen == 9
    damaged = payloads.selectExpr("address", "concat(cast('x' AS binary), substring(payload, 2)) AS payload")
    with pytest.raises(Exception, match="payload and header differ"):
        archive.verified(archive.read_records(archive.rebuild_records(headers, damaged))).collect()
    assert archive.rebuild_records(*archive.archive_pages(pages(spark).limit(0))).collect() == []


def test_archive_loses_no_record(spark):
    import pytest

    headers, payloads = archive.archive_pages(pages(spark))
    read = lambda h, p: archive.verified(archive.read_records(archive.rebuild_records(h, p))).collect()
    address = headers.where("page_id = 9").first().address
    with pytest.raises(Exception, match="no payload is stored: page 9"):
        read(headers, payloads.where(f"address <> '{address}'"))
    with pytest.raises(Exception, match="the response of a revisit is missing: page (1|3|null)"):
        read(headers.where("page_id IS NULL OR page_id <> 7"), payloads)
    other = headers.selectExpr("page_id", "address", "size", "if(page_id = 7, encode(replace(cast(header AS string), 'sha1:', 'sha1:0'), 'UTF-8'), header) AS header")
    with pytest.raises(Exception, match="revisit and response differ"):
        archive.rebuild_records(other, payloads).collect()
    # A sound SHA-1 does not make up for a payload that is kept under a wrong SHA-256.
    moved = payloads.selectExpr("if(address = '%s', repeat('0', 64), address) AS address" % address, "payload")
    renamed = headers.selectExpr("page_id", "if(page_id = 9, repeat('0', 64), address) AS address", "size", "header")
    with pytest.raises(Exception, match="another SHA-256: page 9"):
        read(renamed, moved)
    broken = headers.selectExpr("page_id", "address", "size", "if(page_id = 5, encode('x', 'UTF-8'), header) AS header")
    with pytest.raises(Exception, match="neither response nor revisit: page 5"):
        read(broken, payloads)


def test_archive_of_many_pages_with_one_payload_and_a_long_one(spark):
    rows = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id = 5 THEN repeat('long ', 400000) WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN repeat('copy ', 300) ELSE string(id) END AS html")
    read = archive.verified(archive.read_records(archive.rebuild_records(*archive.archive_pages(rows)))).collect()
    kinds = Counter((r.record_type, r.payload_bytes in (0, 1500), r.refers_to) for r in read)
    assert kinds == {("response", True, None): 1001, ("revisit", True, 2998): 999, ("response", False, None): 1000}
    assert {r.page_id for r in read} == set(range(3000)) and max(r.payload_bytes for r in read) == 2_000_000


def test_quotation_links(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nAnd a dict?"),
        (1, 1, "assistant", "> How do I   SORT a list?\nUse sorted."),
        (1, 2, "user", "> And a dict?\n\nNobody answered this."),
        (1, 3, "user", ">> How do I sort a list?\n> Use sorted.\nThat copies it."),
        (1, 4, "assistant", "> > And a dict?\n> Nobody answered this.\nSort its items."),
        (1, 5, "user", "> a line nobody wrote\nhello"),
        (2, 0, "user", "> Use sorted.\nother conversation"),
        (2, 1, None, None),
        (None, 3, "user", "> x"),
        (3, None, "user", "plain"),
        (4, 0, "user", "same"),
        (4, 1, "user", "same"),
        (4, 2, "user", "> same\nto the latest"),
        (4, 3, "user", "> same\nto the latest"),
        (4, 3, "user", "> same\nto the latest"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS source")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread_turn, r.depth, r.n_quoted, r.body) for r in chat.link_quotations(df).collect()}
    assert got[1, 0] == (None, 0, 0, 0, "How do I sort a list?\nAnd a dict?")
    assert got[1, 1] == (0, 0, 1, 1, "Use sorted.")
    assert got[1, 2] == (0, 0, 1, 1, "Nobody answered this.")
    assert got[1, 3] == (1, 0, 2, 2, "That copies it.")
    assert got[1, 4] == (2, 0, 2, 2, "Sort its items.")
    assert got[1, 5] == (None, 5, 0, 1, "hello")
    assert got[2, 0][:3] == (None, 0, 0) and got[2, 1] == (None, 1, 0, 0, "")
    assert got[4, 2][0] == 1 == got[4, 3][0]
    assert chat.link_quotations(df).count() == len(rows)
    assert chat.link_quotations(df.limit(0)).collect() == []


def test_wrapped_partial_and_nested_quotes(spark):
    long = "The first paragraph of this message has a good many words so that it has to be wrapped.\nAnother one follows here, which nobody quotes at all."
    rows = [
        (1, 0, "u", long),
        (1, 1, "u", "Thanks,\nann and a few more words to make this message longer"),
        (1, 2, "u", "> The first paragraph of this message\n> has a good many words so that it\n> has to be WRAPPED.\n\nIndeed.\n\n> Thanks,"),
        (1, 3, "u", "> > first paragraph of this message has a good many words\n> Indeed.\nYes."),
        (1, 4, "u", "> words that stand nowhere in any earlier message, and first paragraph\nno"),
        (1, 5, "u", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS message", "2 AS level", "3 AS place")
    got = {r.turn: r for r in chat.link_quotations(df).collect()}
    assert [got[k].reply_to for k in range(6)] == [None, None, 0, 2, None, None]
    sources = {(r.turn, r.level): r.source for r in chat.passage_sources(df).where("turn = 3").collect()}
    assert sources == {(3, 2): 0, (3, 1): 2}
    threads = {r.thread_turn: r for r in chat.build_conversations(chat.link_quotations(df)).collect()}
    assert threads[0].n_messages == 3 and ">" not in threads[0].text.replace("<|u|>", "").replace("<|end|>", "")
    assert threads[0].text.index("WRAPPED" if "WRAPPED" in threads[0].text else "wrapped") < threads[0].text.index("Indeed.") < threads[0].text.index("Yes.")


def test_windows_of_one_conversation_are_dealt(spark, monkeypatch):
    """The windows of a conversation are many rows, which do not have to fit into one task."""
    words = [" ".join(f"w{turn}x{k}" for k in range(20)) for turn in range(30)]
    rows = [(1, turn, "user", f"> {words[turn - 1]}\n{words[turn]}" if turn else words[0]) for turn in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    monkeypatch.setattr(chat, "PIECE", 1000, raising=False)
    sources = chat.passage_sources(df)
    plan = sources._jdf.queryExecution().executedPlan().toString()
    [pieces] = {int(n) for n in re.findall(r"hashpartitioning\(conv_id#\d+L, digest#\d+, (\d+)\)", plan)}
    assert pieces == -(-sum(len(r[3]) for r in rows) // 1000) > 4
    assert sorted((r.turn, r.source) for r in sources.collect()) == [(turn, turn - 1) for turn in range(1, 30)]


def test_long_reply_chains(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, k, "u", f"> line {k - 1}\nline {k}") for k in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link_quotations(df).collect()
    assert sorted((r.turn, r.depth, r.thread_turn) for r in got) == [(k, k, 0) for k in range(40)]


def item_texts():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (14, 30, 30, 45, 60)] + ["tiny item", "one two three four five"]
    docs = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        passage = rng.choice(items).split()
        if k % 3 == 0:
            for _ in range(rng.choice((0, 0, 1, 1, 2, 6))):
                passage[rng.randrange(len(passage))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = passage
        docs.append("  ".join(text).upper() if k % 2 else "\n".join(text))
    return docs + [None, "", items[3], items[3][: len(items[3]) * 9 // 10]], items


def test_contamination_equals_brute_force(spark):
    docs, items = item_texts()
    d = list(enumerate(docs)) + [(63, docs[0]), (63, docs[0])]
    b = [*enumerate(items), (50, None), (51, "")]
    df = spark.createDataFrame(d, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n", "3 AS k1", "4 AS k2", "5 AS document")
    bench = spark.createDataFrame(b, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_contamination(df, bench).collect()}
    want = {k: round(v, 9) for k, v in brute.contamination(d, b).items()}
    assert got == want and len(want) >= 10
    bad = {k for k, _ in brute.contamination([(k, t) for k, (_, t) in enumerate(d)], b)}
    kept = decontaminate.drop_contaminated(df, bench)
    assert all((r.k1, r.k2, r.document) == (3, 4, 5) for r in kept.collect())
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(row) for k, row in enumerate(d) if k not in bad)
    assert kept.columns == df.columns
    assert decontaminate.find_contamination(df.limit(0), bench).collect() == []
    assert decontaminate.find_contamination(df, bench.limit(0)).collect() == []


def test_contamination_of_long_texts_and_repeated_items(spark, monkeypatch):
    docs, items = item_texts()
    long = f"{'filler words of a very long text ' * 8_000} {items[2]} {'and some more of them ' * 1000}"
    df = spark.createDataFrame([(1, long), (None, items[1]), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(2, items[2]), (2, items[2]), (2, items[4]), (None, items[1]), (7, "the same words " * 30)], "item_id long, text string")
    want = [(1, 2, 56_000, 30, 1.0), (None, None, 0, 30, 1.0)]
    for rows in (decontaminate.MOST_BROADCAST, 0):
        monkeypatch.setattr(decontaminate, "MOST_BROADCAST", rows)
        assert sorted(map(tuple, decontaminate.find_contamination(df, bench).collect()), key=str) == sorted(want, key=str)


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << k
        pairs.append((a - 2**63, b - 2**63))
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    shared = df.select(F.size(F.array_intersect(decontaminate.blocks(F.col("a")), decontaminate.blocks(F.col("b")))).alias("n"))
    assert shared.where("n = 0").count() == 0


def test_long_pre_tokens_in_every_document(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    texts = ["-" * 60 + f" line {k} " + "=" * 200 + "\n" + " " * 100 + "x" for k in range(50)] + ["word " * 200_000, "\0" + "f" * 32]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head = tokens.frequent_pieces(df, tokens.vocabulary_path())
    assert tokens.head_key(" " + "=" * 200) in head and all(len(k) < tokens.LONG_PIECE for k in head)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_contamination_of_a_text_that_repeats_an_item(spark):
    """A match that goes on for a hundred thousand words is cut into pieces; its windows cost what they cost apart."""
    words = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words)))], "item_id long, text string")
    text = " ".join(words * 1700)
    assert len(text) > 300_000
    rows = [(7, "before it " + text), (8, " ".join(words[:30] + ["x"] * 200 + words[30:])), (9, " ".join(["y"] * 130 + words))]
    got = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.similarity) for r in got) == [(7, 1, 2, 60, 1.0), (9, 1, 130, 60, 1.0)]
