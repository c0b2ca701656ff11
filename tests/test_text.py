from __future__ import annotations

import itertools
import random
import re
import tracemalloc
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechlake.functions import edits, text
from speechlake.operators import evaluation, lexicon


def test_numbers(one):
    cases = {
        "0": "영", "7": "칠", "10": "십", "11": "십일", "20": "이십", "110": "백십", "1000": "천", "2015": "이천십오",
        "9999": "구천구백구십구", "12345": "12345", "007": "007", "a10b": "a십b", "3-4": "삼-사", "": "", "１２": "십이",
        "1e5 00": "일e오 00",
    }
    assert one(list(cases), text.spell_numbers) == list(cases.values())


def test_every_number_up_to_four_digits(spark):
    digits, units = text.DIGITS, text.UNITS

    def read(n):
        if n == 0:
            return "영"
        made = ""
        for place in (3, 2, 1, 0):
            d = n // 10**place % 10
            if d:
                made += (digits[d] if d > 1 or place == 0 else "") + units[place]
        return made

    rows = spark.range(10000).select("id", text.spell_numbers(F.col("id").cast("string")).alias("s")).collect()
    assert all(r.s == read(r.id) for r in rows)


def test_letters(one):
    cases = {
        "a": "에이", "A b": "에이 비", "x-ray": "x-ray", "b.c": "비.씨", "가a나": "가에이나", "ab": "ab", "a@b": "a@b",
        "(z)": "(제트)", "z)": "제트)", "a a a": "에이 에이 에이", "-a": "-a", "a-": "a-", "": "", "ñ": "ñ", "\na\n": "\n에이\n",
    }
    assert one(list(cases), text.spell_letters) == list(cases.values())


def test_percent(one):
    assert one(["5%", "５％"], text.spell_percent) == ["5퍼센트", "５퍼센트"]


def limited(s: str, most: int = 3) -> str:
    s = unicodedata.normalize("NFC", s)
    parts = ["".join(g) for _, g in itertools.groupby(s, str.isspace)]
    out, last, count = [], None, 0
    for p in parts:
        if p.isspace():
            out.append(p)
            continue
        last, count = (p, count + 1) if p == last else (p, 1)
        if count <= most:
            out.append("".join("".join(itertools.islice(g, most)) for _, g in itertools.groupby(p)))
    # Characters are limited in the tokens that are left after the word pass.
    joined = "".join(out)
    tokens = ["".join(g) for _, g in itertools.groupby(joined, str.isspace)]
    return "".join(
        t if t.isspace() else "".join("".join(itertools.islice(g, most)) for _, g in itertools.groupby(t)) for t in tokens
    ).strip()


def test_repeats(one):
    rnd = random.Random(1)
    texts = ["", " ", "a a a", "a a a a", "a a a a b a", "ㅋㅋㅋㅋㅋ", "aaaa aaaa", "aaaaa aaa aaa aaa", " a  a\ta\na a "]
    texts += ["".join(rnd.choice("ab \n가") for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    assert one(texts, text.limit_repeats) == [limited(t) for t in texts]
    assert one(["a a a"], lambda c: text.limit_repeats(c, 1)) == ["a"]
    assert one(["a"], lambda c: text.limit_repeats(c, 0)) == [""]


def test_canonical_forms(one):
    word = "각하 é"
    nfd = unicodedata.normalize("NFD", word)
    assert one([word, nfd, "abc", None], text.nfd) == [nfd, nfd, "abc", None]
    assert one([nfd, word], text.nfc) == [word, word]


def test_foreign_characters(one):
    cases = {"": False, "가 나\n": False, unicodedata.normalize("NFD", "각"): False, "가a": True, "가1": True, "가.": True, None: False}
    assert one(list(cases), text.has_foreign_chars) == list(cases.values())


def test_every_code_point_is_as_foreign_as_what_it_decomposes_to(spark):
    inside = re.compile(rf"[{text.HANGUL_RANGES}\s\x1c-\x1f]")
    for n in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
        made = unicodedata.normalize("NFD", chr(n))
        assert bool(inside.match(chr(n))) == all(inside.match(c) for c in made), hex(n)


def test_foreign_characters_need_no_python(spark):
    df = spark.createDataFrame([("가",)], "s string").select(text.has_foreign_chars(F.col("s")))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_whitespace_at_the_ends(spark):
    spaces = [chr(n) for n in range(0x10000) if not 0xD800 <= n < 0xE000 and chr(n).isspace()]
    assert set(text.SPACES) == set(spaces)
    df = spark.createDataFrame([(c + "a" + c + "b" + c + c, c) for c in [*spaces, "\u200b"]], "s string, c string")
    assert all(r.x == (r.s.strip() if r.c.isspace() else r.s) for r in df.withColumn("x", text.strip(F.col("s"))).collect())


def test_single_letters_by_their_neighbours(one):
    marks = ["", " ", "\n", "\u2028", "\xa0", "-", "b", "é", "가", "ᄀ", ")", "(", "“", "”", "/", "\\", "😀", "a"]
    texts = [x + "a" + y for x in marks for y in marks]
    opening = set(" \n\u2028\xa0([{\"'“‘,.:;!?/\\가ᄀ")
    closing = set(" \n\u2028\xa0)]}\"'”’,.:;!?/\\가ᄀ")
    alone = lambda t, i: (not i or t[i - 1] in opening) and (i + 1 == len(t) or t[i + 1] in closing)
    want = ["".join(text.LETTERS.get(c, c) if alone(t, i) else c for i, c in enumerate(t)) for t in texts]
    assert one(texts, text.spell_letters) == want


def test_ids_of_texts(spark, one):
    texts = ["", None, "ab 9", "z"]
    assert one(texts, text.text_to_ids) == [[], None, [0, 1, 36, 35], [25]]
    assert one(texts, lambda c: text.ids_to_text(text.text_to_ids(c))) == texts
    df = spark.createDataFrame([([0, None, 99, -1, 1],), (None,), ([],)], "i array<int>")
    assert [r[0] for r in df.select(text.ids_to_text("i")).collect()] == ["ab", None, ""]
    with pytest.raises(Exception, match="outside the alphabet: é"):
        one(["abé"], text.text_to_ids)
    plan = spark.createDataFrame([("a",)], "s string").select(text.ids_to_text(text.text_to_ids("s")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


def test_normal_forms(one):
    assert one(["A-b  c!", " É x "], text.normalize_basic) == ["a b  c", "x"]
    assert one(["A-b  ç!\t1"], lambda c: text.normalize_unicode(text.nfd(c))) == ["a b c 1"]
    assert one(["  a_b, 가! "], text.alignment_text) == ["a_b 가"]
    assert one(["Straße, Ñandú!"], text.clean_text) == ["strasse nandu"]
    assert one(["a, b;  c."], text.drop_punctuation) == ["a b c"]
    assert one(["AA1", "", "sp", "spn", "b"], lambda c: text.phone_label(c, False)) == ["aa", "sil", "sil", "sil", "b"]
    assert one(["spn"], lambda c: text.phone_label(c, True)) == ["spn"]
    assert one(["ab 9"], text.text_to_ids) == [[0, 1, 36, 35]]
    assert one(["ab 9"], lambda c: text.ids_to_text(text.text_to_ids(c))) == ["ab 9"]


def distance(x, y) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_word_distance(spark):
    rnd = random.Random(2)
    sentence = lambda n: " ".join(rnd.choice(["a", "bb", "가", "c", "dd"]) for _ in range(n))
    pairs = [(sentence(rnd.randint(0, 30)), sentence(rnd.randint(0, 30))) for _ in range(60)] + [("", ""), (" a ", "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, t string")
    rows = df.select("i", edits.word_distance(F.col("p"), F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == [distance(p.split(), t.split()) for p, t in pairs]


def table_script(x, y) -> tuple[list[int], list[int]]:
    """The same from the whole table."""
    cost = [[distance(x[:i], y[:j]) for j in range(len(y) + 1)] for i in range(len(x) + 1)]
    i, j, ops_x, ops_y = len(x), len(y), [2] * len(x), [3] * len(y)
    while i and j:
        same = x[i - 1] == y[j - 1]
        if same or cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            ops_x[i] = ops_y[j] = 0 if same else 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return ops_x, ops_y


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_script_is_minimal_and_consistent(x, y):
    ops_x, ops_y = (o.tolist() for o in edits.script(x, y))
    assert (ops_x, ops_y) == table_script(x, y)
    assert len(ops_x) == len(x) and len(ops_y) == len(y)
    kept_x = [(a, o) for a, o in zip(x, ops_x) if o in (0, 1)]
    kept_y = [(b, o) for b, o in zip(y, ops_y) if o in (0, 1)]
    assert [o for _, o in kept_x] == [o for _, o in kept_y]
    assert all((a == b) == (o == 0) for (a, o), (b, _) in zip(kept_x, kept_y))
    cost = sum(o != 0 for o in ops_x) + sum(o == 3 for o in ops_y)
    assert cost == distance(x, y)


def test_edit_script_ties():
    ops = lambda x, y: tuple(o.tolist() for o in edits.script(list(x), list(y)))
    assert ops("ab", "b") == ([2, 0], [0])
    assert ops("a", "b") == ([1], [1])
    assert ops("", "ab") == ([], [3, 3])


def test_edit_script_of_long_texts_in_little_memory():
    rnd = random.Random(4)
    x = [rnd.randrange(50) for _ in range(3000)]
    y = [v for v in x if rnd.random() < 0.9]
    y[100:100] = [99] * 200
    tracemalloc.start()
    ops_x, ops_y = edits.script(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # the whole table has 35 MB
    assert (ops_x != 0).sum() + (ops_y == 3).sum() == distance(x, y)


def test_edit_scripts_of_columns(spark):
    rows = [(1, ["a", "b"], ["b"]), (2, [], []), (3, None, ["a"])]
    df = spark.createDataFrame(rows, "i int, x array<string>, y array<string>").select("i", edits.edit_script("x", "y").alias("s"))
    assert {r.i: (r.s.x, r.s.y) for r in df.collect()} == {1: ([2, 0], [0]), 2: ([], []), 3: (None, None)}


def test_error_counts_follow_the_fuller_form(spark):
    df = spark.createDataFrame([(1, "hello wrld", "Hello, world!"), (2, "가나", "가다"), (3, None, "")], "i int, prediction string, target string")
    rows = {r.i: r for r in evaluation.error_counts(df).collect()}
    assert (rows[1].char_err, rows[1].char_len, rows[1].word_err, rows[1].word_len) == (1, 11, 1, 2)
    # Hangul is scored by its parts: two syllables are four letters, one of them differs.
    assert (rows[2].char_err, rows[2].char_len, rows[2].word_err) == (1, 4, 1)
    assert (rows[3].char_err, rows[3].char_len, rows[3].word_len) == (0, 1, 1)


def test_pronounce_keeps_order_and_unknown_words(spark):
    df = spark.createDataFrame([(1, "b a b", "x"), (2, "", "a")], "i int, p string, t string")
    words = spark.createDataFrame([("a", "AA"), ("b", "BB")], "word string, phones string")
    rows = lexicon.pronounce(df, ["i"], ["p", "t"], words).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [(1, "BB AA BB", "x"), (2, "", "AA")]
