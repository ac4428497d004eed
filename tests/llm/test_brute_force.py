"""Operators that SQL can't express, held against plain loops written from their descriptions."""

import collections
import datetime as dt
import hashlib
import itertools
import random
import unicodedata

import pytest

from sluice.llm import decontaminate, language_id, pseudonyms, spot_signatures

DOC = "doc_id long, text string, lang string"


def low(c):
    return c.lower() if len(c.lower()) == 1 else c


def kind(c):
    k = unicodedata.category(c)
    return "L" if k[0] == "L" else "M" if k in ("Mn", "Mc") else "N" if k[0] == "N" else ""


def words_of(text, digits=True):
    out, held = [], ""
    for c in text + " ":
        if kind(c) and (digits or kind(c) != "N"):
            held += low(c)
        elif held:
            out.append(held)
            held = ""
    return out


# --- language profiles ---


def grams(text):
    out = collections.Counter()
    for w in words_of(text, False):
        p = f" {w} "
        out.update([*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(w)))])
    return out if any(kind(c) == "L" for c in text) else collections.Counter()


def ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:top]]


def test_languages_equal_plain_loops(spark):
    rng = random.Random(11)
    kinds = {"aa": "ba ka ta sha né".split(), "bb": "oru enz ith qu ka".split(), "cc": "ми на ko é".split()}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 25))) + rng.choice(["", " 12 é", "!"]), k) for i, k in enumerate(itertools.islice(itertools.cycle(kinds), 60))]
    rows += [(100 + i, t, None) for i, t in enumerate([None, "", "12 34", "́", "x" * 5000, "ka na", "oru ba ka ми"])]
    top = 40
    table = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(table, language_id.fit(table, top=top)).collect()}
    profiles = {k: {g: i for i, g in enumerate(ranked(sum((grams(t) for t in {t for _, t, x in rows if x == k and t}), collections.Counter()), top))} for k in sorted(kinds)}
    for i, t, _ in rows:
        own = ranked(grams(t or ""), top)
        far = {k: sum(abs(p[g] - r) if g in p else top for r, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        rest = [d for k, d in far.items() if k != best]
        want = (best, min(1, max(0, 1 - far[best] / max(1, sum(rest) / len(rest))))) if own else ("und", 0.0)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1]), (i, t)


# --- spot signatures ---


def spots(text):
    words = words_of(text)
    anchor = [w in spot_signatures.ANCHORS for w in words]
    out = set()
    for i, w in enumerate(words):
        after = [x for x, a in zip(words[i + 1 :], anchor[i + 1 :], strict=True) if not a][: spot_signatures.CHAIN]
        if anchor[i] and len(after) == spot_signatures.CHAIN:
            out.add((w, *after))
    if out or not words:
        return out
    n = min(len(words), spot_signatures.CHAIN + 1)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spot_signatures_equal_plain_loops(spark):
    rng = random.Random(12)
    vocabulary = ["the", "of", "Und", "los", "Más", *(f"w{k}é" for k in range(12)), "X9"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(30)] + ["", None, "of the", "lone", "the one two", "x" * 90_000, "one two three four", "the a b the"]
    table = spark.createDataFrame([(i * 10**17 - 10**18, t, None) for i, t in enumerate(texts)], DOC)
    rows = {r.doc_id: r for r in spot_signatures.neighbours(table, spot_signatures._compare, spot_signatures.SCHEMA).collect()}
    for i in range(len(texts)):
        own, after = texts[i] or "", texts[i - 1] or ""
        half = len(own) // 2
        a, b, c = spots(own), spots(own[: len(own) - half] + after[:half]), spots(after)
        r = rows[i * 10**17 - 10**18]
        assert len(spot_signatures.parsed(r.fingerprint)) == len(a) and len(spot_signatures.parsed(r.edited_fingerprint)) == len(b)
        assert (r.near_edited, r.near_next) == (pytest.approx(jaccard(a, b)), pytest.approx(jaccard(a, c)))


def test_neighbours_of_ids_far_apart(spark):
    ids = [-(1 << 63) + 1, *range(300), (1 << 63) - 1]
    table = spark.createDataFrame([(i, f"word {i}", None) for i in ids], DOC)
    rows = {r.doc_id: r for r in spot_signatures.neighbours(table, spot_signatures._compare, spot_signatures.SCHEMA).collect()}
    for i, d in enumerate(ids):
        own, after = f"word {d}", f"word {ids[i - 1]}"
        half = len(own) // 2
        assert rows[d].edited_sha256 == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()
    _, ends = spot_signatures._buckets(table.select("doc_id", "text"), 8)
    assert len(ends) == 8


# --- pseudonyms ---


def noise(tweak, half, turn, key):
    return hashlib.sha256(f"{key}|{tweak}|{turn}|{half}".encode()).hexdigest()


def network(text, alphabets, tweak, key, back=False):
    def moved(part, by):
        out = ""
        for i, c in enumerate(part):
            a = next((a for a in alphabets if c in a), None)
            step = int(by[i % 16 * 4 :][:4], 16)
            out += a[(a.index(c) + (-step if back else step)) % len(a)] if a else c
        return out

    turns = range(pseudonyms.ROUNDS)
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for k in reversed(turns) if back else turns:
        left, right = (moved(right, noise(tweak, left, k, key)), left) if back else (right, moved(left, noise(tweak, right, k, key)))
    return left + right


def pair(x, y, n, m, tweak, key, back=False):
    sign = -1 if back else 1
    for k in reversed(range(pseudonyms.ROUNDS)) if back else range(pseudonyms.ROUNDS):
        if k % 2:
            y = (y + sign * int(noise(tweak, x, k, key)[:8], 16)) % m
        else:
            x = (x + sign * int(noise(tweak, y, k, key)[:8], 16)) % n
    return x, y


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def number(d, key, back=False):
    area = int(d[:3])
    if len(d) == 9 and area not in (0, 666) and area < 900 and d[3:5] != "00" and d[5:] != "0000":
        i = ((area - (2 if area > 666 else 1)) * 99 + int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1
        a, b = pair(*divmod(i, 29997), 29634, 29997, "social", key, back)
        rest, serial = divmod(a * 29997 + b, 9999)
        area, group = divmod(rest, 99)
        return f"{area + (2 if area >= 665 else 1):03}{group + 1:02}{serial + 1:04}"
    if len(d) == 10 and d[0] > "1" and d[3] > "1":
        a, b = pair((area - 200) * 100 + int(d[6:8]), (int(d[3:6]) - 200) * 100 + int(d[8:]), 80_000, 80_000, "american", key, back)
        return f"{a // 100 + 200}{b // 100 + 200}{a % 100:02}{b % 100:02}"
    if len(d) >= 13 and luhn(d) == 0:
        body = network(d[:-1], ["0123456789"], "card", key, back)
        return body + str((10 - luhn(body + "0")) % 10)
    return network(d, ["0123456789"], "number", key, back)


def date(x, key, back=False):
    day = dt.date.fromisoformat(x)
    first, long, short = dt.date(1800, 1, 1), 773, 189
    if day.year < 200:
        first, long, short = dt.date(1, 1, 1), 5591, 13
    elif day.year >= 9800:
        first, long, short = dt.date(9800, 1, 1), 397, 184
    since = (day - first).days
    at = since % (long * short)
    a, b = pair(at % short, at // short, short, long, "date", key, back)
    return (first + dt.timedelta(since - at + a + b * short)).isoformat()


def address(x, key, back=False):
    p = list(map(int, x.split(".")))
    a, b = pair(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ipv4", key, back)
    return ".".join(map(str, (*divmod(a, 256), *divmod(b, 256))))


def mail(x, key, back=False):
    local, _, host = x.partition("@")
    return network(local, [pseudonyms.DIGITS, pseudonyms.LOWER, pseudonyms.UPPER], "mail", key, back) + "@" + host


def test_networks_equal_plain_loops_and_go_back(spark):
    from pyspark.sql import functions as F

    rng, key = random.Random(13), "some key"
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cards = [(d := digits(n - 1)) + str((10 - luhn(d + "0")) % 10) for n in (13, 15, 16, 19) for _ in range(20)]
    values = [(v, number) for v in [*cards, *(digits(n) for n in (9, 9, 9, 10, 10, 11, 12, 13, 16, 19) for _ in range(25)), "665999999", "667010001", "001010001", "899999999", "2002000000", "9999999999"]]
    values += [((dt.date(1, 1, 1) + dt.timedelta(rng.randrange(3_652_059))).isoformat(), date) for _ in range(150)]
    values += [(x, date) for x in ("0001-01-01", "0199-12-31", "0200-01-01", "9799-12-31", "9800-01-01", "9999-12-31", "2000-02-29")]
    values += [(".".join(str(rng.randrange(256)) for _ in range(4)), address) for _ in range(100)]
    values += [("".join(rng.choice("abcXYZ019._") for _ in range(rng.randrange(1, 12))) + "@a.example", mail) for _ in range(60)]
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(values)], "i int, x string").select("i", pseudonyms.pseudonym(F.col("x"), key).alias("y")).collect()
    for r in rows:
        v, plain = values[r.i]
        assert r.y == plain(v, key), v
        if plain is not number or len(v) != len(r.y) or plain(r.y, key, True) == v:
            assert plain(r.y, key, True) == v
        else:
            # a number of no kind may have become one of a kind, which its own network takes back
            assert network(r.y, ["0123456789"], "number", key, True) == v


# --- benchmark templates ---


def tokens(text):
    """(word in lower case, placeholder or '', starts a sentence, joins the word before to a name)."""
    n, inside = len(text), []
    for i, c in enumerate(text):
        joint = c in ".," and 0 < i < n - 1 and kind(text[i - 1]) == "N" == kind(text[i + 1])
        inside.append(bool(kind(c)) or joint)
    out, end, i = [], 0, 0
    while i < n:
        if not inside[i]:
            i += 1
            continue
        j = i
        while j < n and inside[j]:
            j += 1
        raw, gap = text[i:j], text[end:i]
        num = any(kind(c) == "N" for c in raw)
        begins = not out
        unit = not begins and out[-1]["num"] and "".join(map(low, raw)) in decontaminate.UNITS
        upper = [c != low(c) and bool(kind(c)) for c in raw]
        capital = not num and upper[0] and not (len(raw) > 1 and upper[1])
        first = begins or any(c in ".!?:;\n…。！？" for c in gap)
        name = capital and not unit
        more = bool(out) and name and out[-1]["name"] and not first and all(c in " '’-" for c in gap)
        out.append({"w": "".join(map(low, raw)), "num": num, "unit": unit, "name": name, "first": first, "more": more})
        end = i = j
    return out


def templates(text):
    """[(kind, codes, values, first words)] with the number of words last in the first words."""
    t = tokens(text)
    plain = ["#" if x["num"] else "%" if x["unit"] else x["w"] for x in t]
    words, each = [x["w"] for x in t], [*range(len(t) + 1)]
    joined, begin = [], [i for i, x in enumerate(t) if not x["more"]]
    for a, b in zip(begin, [*begin[1:], len(t)], strict=False):
        joined.append(("@" if t[a]["name"] else plain[a], " ".join(words[a:b])))
    return [
        (0, ["@" if x["name"] and not x["first"] else p for x, p in zip(t, plain, strict=True)], words, each),
        (0, plain, words, each),
        (1, [c for c, _ in joined], [v for _, v in joined], [*begin, len(t)]),
    ]


def windows(template, size):
    k, codes, values, starts = template
    for p in range(len(codes) - size + 1):
        c, v = codes[p : p + size], values[p : p + size]
        poor = 2 * sum(x not in "#%@" for x in c) < size or size < decontaminate.PLAIN
        span = tuple(range(starts[p], starts[p + size]))
        yield poor, p, span, (k, size, True, *v), (k, size, False, *c), tuple((x, y) for x, y in zip(c, v, strict=True) if x in ("#", "%", "@"))


def leaked(doc, item):
    runs, n = collections.defaultdict(lambda: (set(), set(), set())), len(tokens(item))
    index = []
    for t in templates(item):
        size = min(len(t[1]), decontaminate.WINDOW)
        mine = list(windows(t, size)) if size else []
        rich = any(not w[0] for w in mine)
        for poor, p, span, said, code, slots in mine:
            if poor:
                index.append((said, p, span, ()))
            if not poor or (not rich and size >= decontaminate.PLAIN):
                index.append((code, p, span, slots))
    for t in templates(doc):
        for size in {k[1] for k, *_ in index}:
            for poor, p, _, said, code, slots in windows(t, size):
                for key, mine in ([(said, ())] if poor else []) + ([(code, slots)] if size >= decontaminate.PLAIN else []):
                    for other, q, span, theirs in index:
                        # slots and plain words of one kind may meet where their codes agree
                        if key == other:
                            covers, same, seen = runs[key[0], p - q]
                            covers.update(span)
                            if [v for _, v in mine] == [v for _, v in theirs]:
                                same.update(span)
                            seen.update(zip((v for _, v in theirs), (v for _, v in mine), strict=True))
    covered = set()
    for covers, same, seen in runs.values():
        if len({v for v, _ in seen}) == len(seen):
            covered |= covers
        else:
            for w in same:
                a = b = w
                while a - 1 in same:
                    a -= 1
                while b + 1 in same:
                    b += 1
                covered |= {w} if b - a + 1 >= decontaminate.RUN else set()
    return len(covered) if covered and (len(covered) >= decontaminate.RUN or 2 * len(covered) >= n) else None


def test_leaks_equal_plain_loops(spark):
    rng = random.Random(14)
    small = "red apples buys sells then gives half of them to the man near old town how many does have left".split()
    names = ["Tom", "Anna", "Mary Jones", "Lee"]

    def sentence():
        parts = [rng.choice(names) if rng.random() < 0.7 else "He"]
        for _ in range(rng.randrange(3, 11)):
            parts.append(rng.choice([*small, rng.choice(names), f"{rng.randrange(30)}", f"{rng.randrange(9)} kg"]))
        return " ".join(parts) + rng.choice(".?!")

    items = [(i, " ".join(sentence() for _ in range(rng.randrange(1, 4)))) for i in range(8)] + [(20, "old town"), (21, "1 2 3 4 5 6 7 8 9"), (22, "Mary Jones Lee"), (23, None), (24, "")]
    docs = []
    for i in range(40):
        text = rng.choice(items[:8])[1]
        for a in names:
            if rng.random() < 0.4:
                text = text.replace(a, rng.choice(names))
        w = text.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice([*small, "7", "12.5"])
        docs.append((i, f"{sentence()} {' '.join(w)} {sentence()}", None))
    docs += [(90, "the old town of 1 2 3 4 5 6 7 8 9, Mary Jones Lee", None), (91, None, None), (92, "2 3 4 5 6 7 8 9 10", None)]
    got = {(r.doc_id, r.item_id): r.covered for r in decontaminate.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): c for d, t, _ in docs for i, x in items if t and x and (c := leaked(t, x)) is not None}
    assert got == want and len(want) > 20
