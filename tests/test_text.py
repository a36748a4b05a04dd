import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwell.functions import text
from linkwell.functions.stem import stem

TOKENIZE = [
    ("", ""), ("Молоко 3,2% 930мл", "молоко 3.2% 930 мл"), ("200г", "200 грамм"), ("Вода 5 л", "вода литр"), ("Сыр 1 кг", "сыр кг"),
    ("Сок 1.5л", "сок 1.5"), ("Рис 5%", "рис 5%"), ("Цена 5. Новая", "цена новая"), ("Объём", "об ем"), ("йогурт", "иогурт"),
    ("44x33", "44 33"), ("№5", "5"), ("Milk 200 ml", "милк 200 мл"), ("Coca-Cola 0,5 л", "цоца цола 0.5"), ("5.-л", "5."),
]
NORMAL = [
    ("200", "200.0"), ("200г", "200.0 грамм"), ("0.5л", "0.5 литр"), ("0,5л", "0.5 литр"), ("44х33", "44.0x33.0"), ("44*33", "44.0x33.0"),
    ("44x33", "44.0x33.0"), ("12кг2", "12.0 кг"), ("г", "грамм"), ("молоко.тест", "молоко тест"),
]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", f(F.col("s")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_tokenize(spark):
    assert column(spark, [a for a, _ in TOKENIZE] + [None], text.tokenize) == [b for _, b in TOKENIZE] + [None]


def test_normal_token(spark):
    assert column(spark, [a for a, _ in NORMAL], text.normal_token) == [b for _, b in NORMAL]


def test_helpers(spark):
    assert column(spark, ["a b a c b"], text.unique_words) == ["a b c"]
    assert column(spark, ["abc 1.5 7"], lambda s: text.mask_numbers(F.split(s, " "))) == [["abc", "<NUMBER>", "<NUMBER>"]]
    assert column(spark, ["{Org A|x", None], text.organisation) == ["Org A", None]
    with pytest.raises(Exception, match="no organisation"):
        column(spark, ["Org A|x"], text.organisation)
    row = spark.createDataFrame([("Молоко Домик", ["Домик молоко 1л"], "Домик"), ("Сыр", [], "Ферма")], "n string, s array<string>, b string")
    assert [r.o for r in row.select(text.product_text(F.col("n"), F.col("s"), F.col("b"), True).alias("o")).collect()] == ["молоко домик 1л", "сыр ферма"]
    assert len(text.stop_words()) > 180


def slow_tokenize(s: str) -> list[str]:
    """What ``tokenize`` must give before letters change, read character by character."""
    out, number, before = [], False, ""
    for c in s:
        c = c.lower()
        if not (32 <= ord(c) <= 126) or c in "*-/":
            out.append(" ")
        elif c.isdigit():
            out.append(c if number else " " + c)
            number, before = True, c
        elif number and c in ".,":
            out.append(".")
            before = "."
        else:
            if number and before == ".":
                out[-1] = out[-1][:-1] + " "
                out.append(c if c not in ".," else " ")
            elif number and c != "%":
                out.append(" " + c)
            elif c in ".,":
                out.append(" ")
            elif before == "%":
                out.append(" " + c)
            else:
                out.append(c)
            number, before = False, c
    return "".join(out).split()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab1.,%-é 2", max_size=12), min_size=20, max_size=40))
def test_number_splitting_agrees_with_a_scan(spark, values):
    def fast(s):
        s = F.regexp_replace(s, r"[^\x20-\x7E]", text.SKIP)
        return text.words(F.replace(text.split_numbers(F.translate(F.lower(s), "*-/", text.SKIP * 3)), F.lit(text.SKIP), F.lit(" ")))

    assert column(spark, values, fast) == [slow_tokenize(v) for v in values]


def test_tokenize_reads_a_name_once(spark):
    rows = spark.createDataFrame([("a",)], "s string").select(text.tokenize(F.col("s")).alias("o"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert column(spark, ["a%b", "1%b", "a.b,", "ab", None], text.split_numbers) == ["a% b", " 1% b", "a b ", "ab", None]


@pytest.mark.parametrize(("word", "root"), [("важная", "важн"), ("вагонами", "вагон"), ("красивейшие", "красив"), ("бегать", "бега"), ("смеявшись", "смея"), ("молочный", "молочн"), ("сила", "сил")])
def test_stem(word, root):
    assert stem(word) == root


def test_chunks_and_quoting(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    assert [r[0] for r in rows.select(text.chunks(F.col("a"), 2)).collect()] == [[[1, 2], [3]], []]
    assert rows.select(text.chunks(F.col("a"), 2, F.lit(0))).first()[0] == [[1, 2], [3, 0]]
    assert column(spark, ["a*b~c/d e", "é-_.+", None], text.url_quote) == ["a%2Ab~c/d%20e", "%C3%A9-_.%2B", None]


def test_analyser(spark):
    assert column(spark, ["Красивые Яблоки и я  РОССИЯ xx", "", None], text.analyse) == [["красив", "яблок", "xx"], [], None]


def test_stems_of_a_batch_take_each_word_once(monkeypatch):
    import pyarrow as pa

    from linkwell.functions import stem

    lists = [["длинный", "дом", "нн", "ь", "hello", None], None, [], ["подъём", "важнейшего", "дом"]] * 3
    want = [x and [w and stem.stem(w) for w in x] for x in lists]
    asked = []
    monkeypatch.setattr(stem, "_known_stem", lambda w: asked.append(w) or stem.stem(w))
    assert stem._stems.func(pa.array(lists, pa.list_(pa.string()))).to_pylist() == want
    assert sorted(asked) == sorted({"длинный", "дом", "подъём", "важнейшего"})
