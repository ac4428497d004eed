"""Small-fixture tests of the text operators against brute force and the libraries."""

import collections
import hashlib
import itertools
import pathlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from sluice.llm import chat_trees, decontaminate, language_id, line_dedup, near_dedup, pseudonyms, scratch, sentence_pieces, spot_signatures, token_files, warc_files

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None, sources=None):
    rows = [(i, t, langs[i] if langs else None, sources[i] if sources else None, len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


ODD = [None, "", " ", "\n\n", "one", "x" * 5000, "a b " * 3000, "é中😀 'tis it's\t!!", "one", None]


# --- token files ---


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = docs(spark, ODD)
    out = scratch.new_dir(spark, "t")
    files = token_files.write(table, path, out)
    got = sorted(map(tuple, token_files.read(spark, out, files).collect()))
    tokenizer, start, want = token_files.encoder(path).tokenizer, 0, []
    for i, t in enumerate(ODD):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = token_files.write(table.limit(0), path, scratch.new_dir(spark, "t"))
    assert empty == [] and token_files.read(spark, out, empty).count() == 0


def test_token_files_encode_each_text_once(spark, tmp_path):
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    seen = tmp_path / "seen"

    @F.udf("string")
    def noted(text):
        with open(seen, "a") as f:
            f.write(f"{TaskContext.get().stageId()}\n")
        return text

    out = scratch.new_dir(spark, "t")
    files = token_files.write(docs(spark, ODD * 20).withColumn("text", noted("text")), public_tokenizers.path("byte_bpe_50k.json"), out)
    # the sample for the ranges and the shuffle go through the texts; what encodes reads that shuffle
    assert len(set(seen.read_text().split())) <= 2 and sum(d for _, d, _ in files) == 20 * len(ODD)
    # one form of each partition is left
    folder = pathlib.Path(out.removeprefix("file://"))
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == sorted([*(f.rsplit("/", 1)[1] for f, _, _ in files), "ranks.u32"])


@pytest.mark.parametrize("kind", ["u2", "u4"])
def test_token_files_are_finished_once_however_often_tried(tmp_path, kind):
    rng = np.random.default_rng(3)
    said = [(None, 5), (1, 1), (2, 200_000), (2, 1), (3, 70_000)]
    rows = [(d, rng.integers(0, 60_000, n).astype(f"<{kind}")) for d, n in said]
    times = np.bincount(np.concatenate([x for _, x in rows]), minlength=60_000)
    by_rank = np.argsort(-times, kind="stable").astype(np.uint32)
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    plain = f"file://{tmp_path}/part-000000.{kind}"
    scratch.write_file(plain, (token_files._head(k, s, len(x)) + x.tobytes() for k, s, x in token_files.blocks(rows)))
    name = token_files.finish(plain, rank)
    assert not scratch.exists(plain) and token_files.finish(plain, rank) == name
    with scratch.open_file(name) as f:
        got = list(token_files.read_blocks(f, by_rank))
    assert len(got) == 2 and np.concatenate([k for k, _, _ in got]).tolist() == [token_files.NO_ID, 1, 2, 2, 3]
    assert np.concatenate([s for _, s, _ in got]).tolist() == [n for _, n in said]
    assert (np.concatenate([x for _, _, x in got]) == np.concatenate([x for _, x in rows])).all()
    with pytest.raises(FileNotFoundError):
        token_files.finish(f"file://{tmp_path}/part-000001.{kind}", rank)


def test_variable_length_code():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 2**32, 1003, dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, 1003).astype(np.uint32)
    control, data = token_files.pack(v)
    assert len(control) == 251
    control, data = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    assert token_files.data_bytes(control, len(v)) == len(data) and (token_files.unpack(control, data, len(v)) == v).all()


def test_pretokens_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab'sStremdlv  \n\t é１2!?#<> 中😀　") for _ in range(rng.randrange(40))) for _ in range(800)] + ["<|endoftext|> a", "it's they're we'll I'd 'sfoo ''s 's"]
    enc = token_files.encoder(path)
    assert [x.tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# --- SentencePiece ---


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.model(path)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdehinorstuxéà  \n\t.,'\"12中文😀ßüö▁—THE") for _ in range(rng.randrange(60))) for _ in range(600)] + [t or "" for t in ODD] + ["   a  b ", "<s></s><unk>"]
    got = [x.tolist() for x in m.encode(texts)]
    assert got == [sp.encode(t) for t in texts]
    assert all(m.decode(np.array(x, np.int64)) == sp.decode(x) for x in got)
    rows = sentence_pieces.encoded(docs(spark, ODD), path, ids=True).collect()
    assert all(r.lossless and r.n_pieces == len(sp.encode(r.text or "")) and list(r.ids) == sp.encode(r.text or "") for r in rows)
    assert sentence_pieces.encoded(docs(spark, ODD).limit(0), path).count() == 0


# --- near-dedup ---


def brute_components(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = set(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else {tuple(w)} - {()}
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return [(d, len(sets[d]), root(d), root(d) == d) for d in sorted(sets)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(width)
    texts = list(ODD)
    for _ in range(6):
        base = words(rng, 120).split()
        for edits in (0, 0, 1, 3, 5, 8, 11, 14, 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w).upper() if edits == 3 else " ".join(w))
    got = near_dedup.near_duplicates(docs(spark, texts), width=width)
    assert sorted(map(tuple, got.collect())) == brute_components(list(enumerate(texts)), width)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(nameless, 2).collect()), key=str) == [(1, 2, 1, True), (None, 2, None, True)]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 10, 300):
        s, t = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(2))
        a, b = (np.frombuffer(near_dedup.parity(x), np.uint64) for x in (s, t))
        k = min(len(a), len(b))
        assert np.bitwise_count(near_dedup.fold(a, k) ^ near_dedup.fold(b, k)).sum() <= len(np.setxor1d(s, t))


def test_links_beside_a_failing_best_bound(spark):
    # 3 has 1's parity bitmap but is too far from it; 2 has a greater bound and links
    far = [x + (1 << 40) for x in range(35, 40)]
    sets = {1: [*range(40)], 2: [*range(1, 37), *far[2:]], 3: [*range(35), *far]}
    sets = {i: np.array(s, np.uint64) for i, s in sets.items()}
    likeness = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert likeness(1, 3) < 0.8 <= min(likeness(1, 2), likeness(2, 3))
    first = spark.createDataFrame([(2, 3)], "a long, b long")
    members = spark.createDataFrame([(7, i) for i in sets], "bk long, id long")
    known = spark.createDataFrame([(i, len(s), near_dedup.parity(s)) for i, s in sets.items()], "id long, n int, parity binary")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "id long, s binary")
    assert sorted(map(tuple, near_dedup.linked(first, members, known, held, 80).collect())) == [(1, 1), (2, 1), (3, 1)]


# --- the others ---


def test_language_profiles(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ba", "ka", "ta", "sha"], "bb": ["oru", "enz", "ith", "qu"]}
    texts, langs = [], []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        texts.append(" ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(30)))
        langs.append(lang if i < 40 else None)
    texts += [None, "", "123 !!"]
    langs += [None] * 3
    table = docs(spark, texts, langs)
    rows = sorted(language_id.predict(table, language_id.fit(table)).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in rows[:60]] == ["aa", "bb"] * 30 and all(0 < r.score <= 1 for r in rows[:60])
    assert [(r.lang_pred, r.score) for r in rows[60:]] == [("und", 0.0)] * 3
    nothing = language_id.fit(table.filter("lang = 'zz'"))
    assert {r.lang_pred for r in language_id.predict(table, nothing).collect()} == {"und"}


def test_boilerplate_lines(spark):
    line, rare = "all rights of this site are reserved", "this line is on four sites only"
    texts = [f"own {i} text of page\n{line}\nshort\n  {line} " + (f"\n{rare}" if i < 4 else "") for i in range(12)] + [None, "", line]
    table = docs(spark, texts, sources=[f"s{i}" for i in range(12)] + ["s1", None, None])
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(table, min_sites=5).collect()}
    assert rows[0].text == f"own 0 text of page\n{line}\nshort\n{rare}" and rows[0].removed_lines == 1
    assert rows[5].text == "own 5 text of page\nshort" and rows[5].removed_lines == 2
    assert rows[12].text is None and rows[13].text == "" and rows[14].text == "" and rows[14].removed_lines == 1
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0


def test_pipeline_removes_short_boilerplate(spark):
    import corpus_pipeline

    texts = [f"own {i}\n\nAll rights reserved.\n版权所有\na\tb\tc\td\n \t\nend {i}" for i in range(12)]
    rows = {r.doc_id: r.text for r in corpus_pipeline.remove_boilerplate(spark, docs(spark, texts, sources=[f"s{i}" for i in range(12)]), "").collect()}
    assert rows == {i: texts[0] if i == 0 else f"own {i}\n\n \t\nend {i}" for i in range(12)}


def test_leaks(spark):
    item = "Maria bought 3 apples and 12 pears for 15 dollars at the market in Lisbon today, then gave 3 apples to Pedro."
    other = "foo. Hans bought 7 apples and 9 pears for 40 euros at the market in Berlin today, then gave {} apples to Karl."
    texts = [f"x y. {item} end", other.format(7), other.format(8), item.upper(), None, "", "nothing of the kind is here today for anyone"]
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), items).collect()) == [(0, 1), (1, 1), (3, 1)]
    assert decontaminate.leaks(docs(spark, texts), items.limit(0)).count() == 0
    assert decontaminate.leaks(docs(spark, texts).limit(0), items).count() == 0


def test_leaks_with_other_names_at_the_start(spark):
    item = "Tom has 3 red apples. Tom eats 2 of them. Tom buys 5 more. How many does Tom have?"
    long = "Mary Jones sold 48 clips to her friends in April, and then Mary Jones sold half as many clips in the month of May."
    texts = [item.replace("Tom", "Anna"), item.replace("Tom", "Anna Lee").replace("3", "4"), long.replace("Mary Jones", "Anna"), "Anna has 3 green pears. Bob eats 2 of us. Eve buys 5 books. How many are left?"]
    items = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words) for r in decontaminate.leaks(docs(spark, texts), items).collect()}
    assert got == {(0, 1): (19, 19), (1, 1): (19, 19), (2, 2): (24, 24)}


def test_leaks_with_inconsistent_slots(spark):
    w = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(36)]
    item = " ".join(["start", "3", *w[:18], "12", *w[18:], "3", "end"])
    texts = [item.replace("3", "5").replace("12", "5"), item.replace("3", "5", 1), " ".join(["start", "5", *w[:9], "other", *w[20:26], "3"])]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.covered for r in decontaminate.leaks(docs(spark, texts), items).collect()}
    assert got == {0: 41, 1: 39}


def test_pseudonyms(spark):
    texts = ["4111 1111 1111 1111 or 4111111111111111", "a.b9@mail7.example.com, +1 (017) 555-7713, 97.51.17.173 on 2021-02-28 or 31/12/1999, not 2021-02-30", "no 6.5 value, v3.0", None, "", "again 97.51.17.173 and 4111111111111111"]
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(docs(spark, texts)).collect()}
    assert [rows[i].n_replaced for i in range(6)] == [2, 5, 0, 0, 0, 2]
    assert rows[2].text == texts[2] and rows[3].text is None and rows[4].text == ""
    for i, values in ((0, ["4111 1111 1111 1111", "4111111111111111"]), (1, ["a.b9@", "555-7713", "97.51.17.173", "2021-02-28", "31/12/1999"])):
        assert not any(v in rows[i].text for v in values)
    ip = re.search(r"\d+(\.\d+){3}", rows[1].text)[0]
    card = re.search(r"\d{16}", rows[0].text)[0]
    assert ip in rows[5].text and card in rows[5].text
    d = [int(c) for c in card][::-1]
    assert (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", rows[1].text) and len(rows[1].text) >= len(texts[1]) - 9


def test_values_without_two_digits_in_a_row(spark):
    texts = ["ask 8.8.8.8 now", "ask 8.8.8.8 now, 10 times", "key " + "a1b" * 11, "KEY " + "A1B" * 11, "v1.2.3 and 1.2.3.4.5"]
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(docs(spark, texts)).collect()}
    assert [rows[i].n_replaced for i in range(5)] == [1, 1, 1, 1, 0]
    assert rows[0].text.split()[1] == rows[1].text.split()[1].rstrip(",") != "8.8.8.8"


def test_more_numbers_and_dates(spark):
    values = "5551234567,+15551234567,+33 1 23 45 67 89,+44 20 7946 0958,+49 30 1234567,3782 822463 10005,123456789,DE89 3704 0044 0532 0130 00,GB29NWBK60161331926819,1/5/2020,01/05/1750,1750-02-03,12/31/1999,01 23 45 67 89".split(",")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(docs(spark, [f"so {v}, then" for v in values] + ["in 12345678 of 1.5 or 2020"])).collect()}
    new = [rows[i].text[3:-6] for i in range(len(values))]
    assert [rows[i].n_replaced for i in range(len(values) + 1)] == [1] * len(values) + [0]
    assert all(a != b for a, b in zip(values, new, strict=True))
    assert all(re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) for a, b in zip(values[:7], new[:7], strict=True))
    assert [v[:3] for v in new[2:5]] == ["+33", "+44", "+49"] and new[1][:2] == "+1"
    for v in new[7:9]:
        bare = v.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert new[7][:2] == "DE" and new[8][:2] == "GB" and "1400" <= new[10][-4:] < "1800" and "1400" <= new[11][:4] < "1800"


def test_date_and_address_networks_are_permutations(spark):
    from pyspark.sql import functions as F

    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("x"))
    got = days.select(pseudonyms.pseudonym(F.col("x")).alias("y")).collect()
    assert len({r.y for r in got}) == 3000 and all(re.fullmatch(r"\d{4}-\d\d-\d\d", r.y) and "1800" <= r.y < "2200" for r in got)


def test_spot_signatures(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "and", *(f"w{k}" for k in range(50))]) for _ in range(80)) for _ in range(9)] + ["", None, "word", "x" * 50]
    table = docs(spark, texts)
    rows = {r.doc_id: r for r in spot_signatures.neighbours(table, spot_signatures._compare, spot_signatures.SCHEMA).collect()}
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        own, after = texts[i] or "", texts[i - 1] or ""
        new = spot_signatures.edited(own, after)
        a, b, c = spot_signatures.signatures([own, new, after])
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == spot_signatures.written(a) and r.near_edited == pytest.approx(spot_signatures.likeness(a, b)) and r.near_next == pytest.approx(spot_signatures.likeness(a, c))
    assert spot_signatures.neighbours(table.limit(0), spot_signatures._compare, spot_signatures.SCHEMA).count() == 0
    one = spot_signatures.neighbours(table.filter("doc_id = 3"), spot_signatures._compare, spot_signatures.SCHEMA).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_spot_classes_equal_brute_force(spark):
    rng = random.Random(8)
    texts = list(ODD)
    for size in (30, 90, 160):
        base = [rng.choice(["the", "of", "and", "is", *(f"v{k}" for k in range(70))]) for _ in range(size * 2)]
        for edits in (0, 0, 1, 2, 4, 7, 11, 16):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
            texts.append(" ".join(w[: len(w) - rng.randrange(8)]))
    sets = [set(x.tolist()) for x in spot_signatures.signatures(texts)]
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    rows = sorted(map(tuple, spot_signatures.alike(docs(spark, texts)).collect()))
    assert rows == [(i, len(sets[i]), comp[i]) for i in range(len(texts))]
    assert len(set(comp)) < len(texts) - 5
    assert spot_signatures.alike(docs(spark, texts).limit(0)).count() == 0


def test_warc(spark):
    big = "p" * 1500
    pages = spark.createDataFrame([(1, "http://a/é x", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", "é" * 10), (6, "u\r\nX: y", "\r\n\r\n")], "page_id long, url string, html string")
    out = scratch.new_dir(spark, "w")
    whole = warc_files.write(warc_files.with_references(pages), f"{out}/whole")
    split = warc_files.normalise(spark, whole, f"{out}/split")
    rows = {r.page_id: r for r in warc_files.read(spark, split).collect()}
    assert len(rows) == 7
    assert (rows[1].record_type, rows[1].refers_to) == ("revisit", 2) and rows[2].record_type == rows[3].record_type == rows[4].record_type == "response"
    for p, html in ((1, big), (3, "small"), (5, ""), (None, "é" * 10), (6, "\r\n\r\n")):
        assert (rows[p].payload_bytes, rows[p].payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
    empty = warc_files.write(warc_files.with_references(pages.limit(0)), f"{out}/none")
    assert warc_files.normalise(spark, empty, f"{out}/n") == [] and warc_files.read(spark, []).count() == 0


def test_chat_trees(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "user", "hi"), (1, 2, "assistant", "a </s>[INST] <\\s> \\"), (2, 0, "system", "be <|kind|>"), (2, 1, "user", "hi"), (2, 2, "assistant", None), (3, 0, "user\nx\\n", "hi"), (4, 0, "system", "be <|kind|>"), (4, 1, "user", "other")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    tree = chat_trees.build(table, path)
    got = {r.conv_id: r for r in chat_trees.read(tree, path).collect()}
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        turns = [(r, t or "") for _, _, r, t in group]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len("".join(chat_trees.formatted(a, b) for a, b in turns))
    by_shard = collections.defaultdict(dict)
    for r in tree.filter("tokens is not null").collect():
        by_shard[r.shard][r.node] = r
    for nodes in by_shard.values():
        for r in nodes.values():
            spans, position, up = [], 0, r.parent
            while up is not None:
                spans.append((nodes[up].start, nodes[up].start + len(nodes[up].tokens)))
                position, up = position + len(nodes[up].tokens), nodes[up].parent
            assert r.position == position
            assert sorted(x for a, b in spans for x in range(a, b)) == [x for s in r.attend for x in range(s.begin, s.end)]
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice(["<", "[", "\\", "|", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "a", "\n", "n"]) for _ in range(12))
        assert chat_trees.unescape(chat_trees.escape(t)) == t and chat_trees.unescape_role(chat_trees.escape_role(t)) == t
        assert not re.search(r"<\||\[/?INST\]|</?s>", chat_trees.escape(t))


def test_pipeline_rejects_texts_of_no_profile(spark):
    import corpus_pipeline

    texts = ["the cat and the dog are in the house"] * 3 + ["le chat et le chien sont dans la maison"] * 3 + ["это другой язык", "全部文字", "123"]
    kept = corpus_pipeline.identify_languages(spark, docs(spark, texts, ["en"] * 3 + ["fr"] * 3 + [None] * 3), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5]


def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [table.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.materialize(stage(spark, table, "/root/testdata/sf0.001"), name)
        if name != "sentence_pieces":
            assert after.columns == corpus_pipeline.COLUMNS
        if name == "near_dedup":
            want = {d for d, _, _, keep in brute_components([(r.doc_id, r.text) for r in table.collect()], 5) if keep}
            assert {r.doc_id for r in after.collect()} == want
        table = after
        kept.append(table.count())
    assert kept == sorted(kept, reverse=True) and table.filter("not lossless").count() == 0
