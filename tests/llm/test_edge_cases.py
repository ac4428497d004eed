"""Nulls, very long rows, ties and repeated rows, empty tables and clashing columns of the operators."""

import hashlib
import random

import public_tokenizers

from sluice.llm import chat_trees, decontaminate, language_id, line_dedup, pseudonyms, sentence_pieces, token_files, warc_files

BPE = public_tokenizers.path("byte_bpe_50k.json")


def digest(turns):
    return hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_chats_with_nul_signs_many_turns_and_repeated_rows(spark):
    rng = random.Random(9)
    long = [(3, k, rng.choice(["user", "assistant"]), f"turn {rng.randrange(50)}") for k in range(10_000)]
    # 4 leaves the long conversation half way; 5 says it all twice over
    fork = [(4, *r[1:]) for r in long[:5000]] + [(4, 5000, "user", "x" * 300_000)]
    rows = [(1, 0, "a\0b", "c"), (2, 0, "a", "b\0c"), (None, 0, "user", "no name"), (None, None, None, None), (6, 0, "user", "same"), (6, 0, "user", "same")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + long + fork], "conv_id long, turn long, role string, text string, h string, shard int")
    tree = chat_trees.build(table, BPE)
    got = {r.conv_id: r for r in chat_trees.read(tree, BPE).collect()}
    said = {}
    for c, _, r, t in rows[:3] + rows[4:] + long + fork:
        said.setdefault(c, []).append((r, t))
    said[None] = [("", ""), ("user", "no name")]
    assert {c: (r.n_turns, r.turns_sha256) for c, r in got.items()} == {c: (len(t), digest(t)) for c, t in said.items()}
    for r in tree.filter("depth = 9999 or depth = 5000").filter("tokens is not null").collect():
        assert r.position == sum(s.end - s.begin for s in r.attend) and len(r.attend) <= 2


def test_chats_of_an_empty_table(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_trees.read(chat_trees.build(nothing, BPE), BPE).count() == 0


def test_odd_sketches_of_similar_sets_pass_the_estimate():
    import numpy as np

    from sluice.llm import near_dedup

    rng, limit, bits = np.random.default_rng(7), near_dedup.apart_limit(80), 64 * near_dedup.ODD_WORDS
    # of 300,000 pairs at the threshold: each sample differs with a chance of 0.2 and then flips two bits
    differ = rng.binomial(near_dedup.SAMPLES, 0.2, 300_000)
    worst = 0
    for n in np.unique(differ):
        flips = rng.integers(0, bits, (int((differ == n).sum()), 2 * int(n)))
        for part in np.array_split(flips, len(flips) // 2000 + 1):
            odd = np.zeros((len(part), bits), np.int16)
            np.add.at(odd, (np.arange(len(part))[:, None], part), 1)
            worst = max(worst, int((odd & 1).sum(axis=1).max()))
    assert worst <= limit < near_dedup.apart_limit(60)
    # and the sketches of real sets follow the same law
    base = rng.integers(0, 2**63, 2000).astype(np.uint64)
    for likeness in (0.5, 0.8, 0.95):
        n = int(2000 * (1 - likeness) / (1 + likeness))
        pairs = [(np.unique(base), np.unique(np.concatenate([base[n:], rng.integers(0, 2**63, n).astype(np.uint64)]))) for _ in range(30)]
        odd = [near_dedup.odd_sketches(np.stack([near_dedup.signature(x) for x in p])).view(np.uint64) for p in pairs]
        apart = np.mean([np.bitwise_count(a ^ b).sum() for a, b in odd])
        flips = 2 * near_dedup.SAMPLES * (1 - likeness)
        assert abs(apart - bits * (1 - (1 - 2 / bits) ** flips) / 2) < 8


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{more}")


def test_items_of_few_words_match_unchanged(spark):
    items = spark.createDataFrame([(1, "capital of France"), (2, "capital of France"), (3, "7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22"), (4, "Zyx"), (5, "? !")], "item_id long, text string")
    texts = ["the capital of France, they say", "the capital of Spain", "capitals of France", "so 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22", "Zyxes", "a zyx b", None, ""]
    docs = frame(spark, [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[0], 1)], ", item_id int")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(0, 1), (0, 2), (3, 3), (5, 4)]


def test_windows_of_few_plain_words_match_unchanged(spark):
    item = "gather the following eight plain numbers now: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19"
    docs = frame(spark, [(1, " ".join(item.split()[7:])), (2, "see 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39")])
    rows = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.covered) for r in rows] == [(1, 19)]


def test_a_text_of_marks_alone_has_no_language(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(3)] + [(9, "\u0301\u0302 \u0303", None), (10, "the", None), (10, "the", None)]
    table = frame(spark, [(*r, 0.5) for r in rows], ", lang string, score double")
    out = language_id.predict(table, language_id.fit(table))
    assert sorted((r.doc_id, r.lang_pred) for r in out.filter("doc_id > 3").collect()) == [(9, "und"), (10, "en"), (10, "en")]
    empty = table.limit(0)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0


def test_repeated_rows_and_taken_names_in_line_dedup(spark):
    line = "read more"
    rows = [(i, f"own {i}\n{line}\n{line}", f"s{i}", i, i, "x") for i in range(6)]
    table = frame(spark, rows + [rows[5]] * 2 + [(7, "\n".join([line] * 20_000), None, 0, 0, "x")], ", source string, gone int, doc int, version string")
    out = line_dedup.dedup_lines(table, min_sites=5, min_words=1)
    assert out.columns == [*table.columns, "removed_lines"]
    got = sorted((r.doc_id, r.text, r.removed_lines, r.gone, r.version) for r in out.collect())
    assert got == [(0, f"own 0\n{line}", 1, 0, "x"), *((i, f"own {i}", 2, i, "x") for i in (1, 2, 3, 4, 5, 5, 5)), (7, "", 20_000, 0, "x")]
    assert all(r.removed_lines == 0 for r in line_dedup.dedup_lines(table, min_sites=5).collect())


def test_pages_without_digest_repeated_and_large(spark):
    big, huge = "b" * 2000, "h" * 5_000_000
    rows = [(i, "u", "small") for i in range(300)] + [(1000 + i, "u", big) for i in range(60)] + [(1059, "u", big), (1058, "u", "other" * 300), (None, "u", big), (None, "u", None), (2000, "u", huge), (2001, "u", huge)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, salt int, digest int")
    out = warc_files.with_references(pages)
    assert out.columns == ["page_id", "url", "html", "refers_to"]
    want = sorted((str(i), h, 1059 if h == big and i not in (None, 1059) else 2001 if (i, h) == (2000, huge) else None) for i, _, h in ((i, u, h or "") for i, u, h in rows))
    assert sorted(((str(r.page_id), r.html, r.refers_to) for r in out.collect()), key=str) == sorted(want, key=str)


def test_long_chunks_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.model(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ABCDabcdefghijklmnopqrst0123456789+/") for _ in range(n)) for n in (600, 160_000)] + ["a" * 200_000, "ab" * 1000, "".join(rng.choice(["tion", "ing", "the"]) for _ in range(60_000)), "中" * 3000, "x 中y" + "😀" * 400]
    assert [x.tolist() for x in m.encode(texts)] == [sp.encode(t) for t in texts]


def test_columns_of_the_names_that_operators_add(spark):
    table = frame(spark, [(1, "call 212 555 7713 or (212) 555-7713", 7, "k", 9), (1, None, 7, "k", 9)], ", found int, by string, n_replaced int")
    out = pseudonyms.pseudonymise(table)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "found", "by", "n_replaced"] and sorted(r.n_replaced for r in rows) == [0, 2] and {r.found for r in rows} == {7}
    assert pseudonyms.pseudonymise(table.limit(0)).count() == 0
    pieces = sentence_pieces.encoded(table.withColumnRenamed("found", "n_pieces"), public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces.columns == ["doc_id", "text", "by", "n_replaced", *sentence_pieces.ADDED] and pieces.count() == 2


def test_the_key_is_in_no_plan(spark):
    out = pseudonyms.pseudonymise(frame(spark, [(1, "4111111111111111")]), "not to be seen")
    shown = out._jdf.queryExecution().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "not to be seen" not in shown and out.first().text != pseudonyms.pseudonymise(frame(spark, [(1, "4111111111111111")])).first().text


def test_token_files_of_long_and_repeated_rows(spark):
    from sluice.llm import scratch

    rows = [(5, "word " * 60_000, 1), (5, "again", 2), (5, "again", 2), (None, "nameless", 3)]
    table = frame(spark, rows, ", start int")
    out = scratch.new_dir(spark, "t")
    got = token_files.read(spark, out, token_files.write(table, BPE, out)).collect()
    sizes = sorted(len(token_files.encoder(BPE).tokenizer.encode(t).ids) + 1 for _, t, _ in rows)
    assert sorted(r.n_tokens for r in got) == sizes and sorted(str(r.doc_id) for r in got) == ["5", "5", "5", "None"]


def test_a_cluster_has_to_name_the_shared_folder(spark):
    import pytest

    from sluice.llm import scratch

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_dir(Session)
