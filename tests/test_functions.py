from pyspark.sql import functions as F

from corpusmill.functions import facts, prompts
from corpusmill.functions import text as tx
from corpusmill.functions.vectors import cosine


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("x"))).collect()]


def test_cleaning(spark):
    assert values(spark, ["  a \tb \x1c", "при-\nмер да", "a\x00b\x7f", None, ""], tx.clean_extracted) == ["a b", "пример да", "ab", None, ""]
    page = "=== Страница 3 ===\n  a\t\tb \n...!?\n\n\x01c d\n"
    assert values(spark, [page, None, ""], tx.clean_lines) == ["a b\nc d", "", ""]
    assert values(spark, ["a\nb\n", "", "a", "\n"], tx.split_lines) == [["a", "b"], [], ["a"], [""]]
    assert values(spark, ["да (Источник: стр. 5) ", "нет (ИСТОЧНИК 1)"], tx.drop_source_notes) == ["да", "нет"]
    assert values(spark, ["<think>x\ny</think> z", "</think>q", None], tx.clean_response) == ["z", "q", ""]
    assert values(spark, ["```json\n[1]\n```", "```\nx\n```", " y "], tx.strip_code_fence) == ["[1]", "x", "y"]
    assert values(spark, ["<a & 'b'>"], tx.html_escape) == ["&lt;a &amp; &#x27;b&#x27;&gt;"]


def test_profile(spark):
    assert values(spark, ["=== Страница 1 ===\n=== Страница 2 ===", "x"], tx.page_count) == [2, 1]
    assert values(spark, ["абв abc", "абвг abc", "ёЁ", ""], tx.language_vote) == ["eng", "rus", "eng", "eng"]
    assert values(spark, [4999, 5000, 29999, 30000], tx.size_bucket, "int") == ["small", "medium", "medium", "large"]
    assert values(spark, ["КОНКУРС заявка", "заявка", "титульный", " " * 600 + "титульный", "x"], tx.document_type) == ["конкурсная_документация", "форма_заявки", "титульный_лист", tx.OTHER_TYPE, tx.OTHER_TYPE]
    text = "".join(chr(97 + k % 26) for k in range(30))
    got = values(spark, [text, text[:12]], lambda c: tx.head_middle_tail(c, 12, "|"))
    assert got == [text[:4] + "|" + text[13:17] + "|" + text[-4:], text[:12]]
    assert values(spark, ["abcdefg", ""], lambda c: tx.slices(c, 3)) == [["abc", "def", "g"], []]


def test_headings_and_chunks(spark):
    from corpusmill.operators.chunking import heading_line, useful

    lines = ["2.1.1 Общие", "2.Общие", "2. Общие", "Раздел 1.", "Требования:", "Требования", "Требования к заявителю", "Сроки 5 дней", "Это предложение.", "x" * 121, "", "условия " + "y" * 80, "бюджет. x"]
    want = [True, True, True, True, True, True, False, True, False, False, False, False, True]
    assert values(spark, lines, tx.is_heading) == want
    assert [heading_line(x) for x in lines] == want
    chunks = ["abcd", "abcde", "a 1", "Раздел: x", "x y z" + "." * 9, "x y z" + "." * 10, "[ТАБЛИЦА] a"]
    want = [False, True, True, True, False, True, True]
    assert values(spark, chunks, tx.is_useful_chunk) == want
    assert [useful(x) for x in chunks] == want


def test_facts(spark):
    found = values(spark, ["1,5 и 1.50", "2e3", "12.05.2024", "1.2.24", "2024-5-1", "нет", "стр5 x", None], facts.extract_facts)
    assert [set(x) for x in found] == [{"1.5"}, {"2000"}, {"12.05", "2024", "12.05.2024"}, {"1.2", "24", "01.02.2024"}, {"2024", "5", "1", "01.05.2024"}, set(), set(), set()]
    pairs = [([], []), (["1"], []), ([], ["1"]), (["1"], ["2"]), (["1", "2"], ["1"])]
    df = spark.createDataFrame([(k, g, r) for k, (g, r) in enumerate(pairs)], "k int, g array<string>, r array<string>")
    got = [tuple(x[0]) for x in df.orderBy("k").select(facts.fact_f1(F.col("g"), F.col("r"))).collect()]
    assert got == [(1.0, False, False), (0.0, False, True), (0.0, True, False), (0.0, True, True), (2 / 3, True, True)]
    df = spark.createDataFrame([("5 и 7", ["5", "x 7."]), ("5", ["55"]), ("нет чисел", []), ("(Источник: 1)", ["1"])], "a string, c array<string>")
    got = [x[0] for x in df.select(facts.guarded_answer(F.col("a"), F.col("c"))).collect()]
    assert got == ["5 и 7", facts.NOT_FOUND, "нет чисел", facts.NOT_FOUND]
    assert values(spark, ["ДА.", " нет", "может быть", None], facts.verdict) == [1, 0, None, None]


def test_prompts(spark):
    df = spark.createDataFrame([(["aa", "bbb", "c"],), ([],), (["x" * 99],)], "c array<string>")
    assert [r[0] for r in df.select(prompts.within_budget(F.col("c"), 5)).collect()] == [["aa", "bbb"], [], []]
    rows = ['[{"question": "q", "answer": "a"}]', '```json\n[{"question": "q", "answer": "a"}]\n```', '[{"question": "q"}]', "bad", None]
    got = values(spark, rows, prompts.parse_qa)
    assert [None if x is None else [tuple(p) for p in x] for x in got] == [[("q", "a")], [("q", "a")], None, None, None]
    ids = [[9, 1, 2, 5, 6], [1, 2], [1, 3, 2], [], [7]]
    got = values(spark, ids, lambda c: prompts.mask_labels(c, 1, [2]), "array<int>")
    assert [tuple(x) for x in got] == [([-100, -100, 2, 5, 6], True), ([-100, 2], True), ([1, 3, 2], False), ([], False), ([7], False)]
    assert values(spark, [[1, 2], []], lambda c: prompts.padded(c, F.lit(3), 0), "array<int>") == [[1, 2, 0], [0, 0, 0]]
    df = spark.createDataFrame([("c", "q", "<think>t</think>\n\na"), ("c", "q", "a")], "c string, q string, a string")
    got = [r[0] for r in df.select(prompts.chat_pair(F.col("c"), F.col("q"), F.col("a"))).collect()]
    head = "<|im_start|>user\nКонтекст: c\nВопрос: q<|im_end|>\n<|im_start|>assistant\n<think>\n"
    assert got == [f"{head}t\n</think>\n\na<|im_end|>\n", f"{head}\n</think>\n\na<|im_end|>\n"]
    df = spark.createDataFrame([(["a" * 50, "b" * 50], "q")], "c array<string>, q string")
    tokens = lambda p: F.length(p)
    whole = len(prompts.RAG_RULES) + 200
    assert df.select(prompts.trimmed_context(F.col("c"), F.col("q"), whole, tokens)).first()[0] == "a" * 50 + "\n---\n" + "b" * 50
    assert df.select(prompts.trimmed_context(F.col("c"), F.col("q"), len(prompts.RAG_RULES) + 90, tokens)).first()[0] == "a" * 50


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(F.round(cosine(F.col("a"), F.col("b")), 6)).collect()] == [1.0, 0.0, None, None]


def test_numbers_print_in_full_or_shortest(spark):
    from pyspark.sql import functions as F

    from corpusmill.functions import facts, text

    said = ["1", "1,5", "1.50", "2e3", "1e20", "100000000000000000000", "1e-5", "0.00012", "0.0001", "0.001", "1.25e-7", "123456.789", "1e18", "3e30", "5e-4", "9007199254740993", "0"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "s string").select(text.canonical_number(F.col("s"))).collect()]
    assert got == [str(int(v)) if v == int(v) else str(v) for v in (float(x.replace(",", ".")) for x in said)]
    dates = spark.createDataFrame([("1.2.124 и 1.2.24",)], "s string").select(facts.extract_facts(F.col("s"))).first()[0]
    assert {"01.02.124", "01.02.2024"} <= set(dates)
