"""Prompts, chat rendering, model-made JSON and token arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import history_time, strip_angle_brackets, strip_code_fence

# The answering prompt, the judging prompt and how chunks are joined.
RAG_RULES = (
    "Ты — эксперт по грантовой документации Российского научного фонда.\n"
    "Отвечай на вопрос пользователя, используя ИСКЛЮЧИТЕЛЬНО приведённый ниже контекст.\n"
    "Правила:\n"
    "- Отвечай только точными фактами из контекста.\n"
    "- Если нужно перечислить несколько пунктов, скопируй их точно как в контексте.\n"
    "- Не изменяй числа, даты, проценты, суммы.\n"
    "- Если в контексте нет ответа, скажи ровно: «Информация не найдена» и остановись.\n"
    "- Не добавляй ничего от себя.\n\n"
)
JUDGE_RULES = (
    "Ты — эксперт по оценке качества ответов ассистента. Тебе дан контекст документа, вопрос пользователя и ответ ассистента.\n\n"
    "Определи, соответствует ли ответ ассистента фактам, изложенным в контексте. Игнорируй служебные теги вроде <think>, если они есть. "
    "Сосредоточься только на фактическом содержании.\n\n"
    'Ответь только "ДА" или "НЕТ".\n\n'
)
CONTEXT_JOIN = "\n---\n"
IGNORED = -100
QA_SCHEMA = "array<struct<question:string,answer:string>>"


def rag_prompt(context: Column, question: Column, rules: str = RAG_RULES) -> Column:
    return F.concat(F.lit(f"{rules}Контекст:\n"), context, F.lit("\n\nВопрос: "), strip_angle_brackets(question), F.lit("\n\nОтвет:"))


def judge_prompt(context: Column, question: Column, answer: Column, rules: str = JUDGE_RULES) -> Column:
    return F.concat(F.lit(f"{rules}Контекст: "), context, F.lit("\n\nВопрос: "), question, F.lit("\n\nОтвет ассистента: "), answer, F.lit('\n\nТвой ответ (только "ДА" или "НЕТ"):'))


def generator_prompt(template: str, chunk: Column) -> Column:
    """A template with the place ``{document_chunk}`` filled in."""
    head, _, tail = template.partition("{document_chunk}")
    return F.concat(F.lit(head), chunk, F.lit(tail))


def chat_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


def chat_pair(context: Column, question: Column, answer: Column) -> Column:
    """The training text of one question and answer: a user turn with context, and the assistant's with empty thinking."""
    user = F.concat(F.lit("Контекст: "), context, F.lit("\nВопрос: "), question)
    thought = F.when(answer.contains("</think>"), F.regexp_extract(answer, r"(?s)(?:.*<think>)?\n*(.*?)\n*</think>", 1)).otherwise(F.lit(""))
    said = F.regexp_replace(F.regexp_replace(answer, r"(?s)\A.*</think>", ""), r"\A\n+", "")
    return F.concat(chat_turn(F.lit("user"), user), chat_turn(F.lit("assistant"), F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), said)))


def within_budget(chunks: Column, budget: int) -> Column:
    """The longest prefix of an array of texts with at most ``budget`` characters in all."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(False).alias("full"))

    def step(s: Column, c: Column) -> Column:
        full = s["full"] | (s["n"] + F.length(c) > budget)
        return F.struct(F.when(full, s["n"]).otherwise(s["n"] + F.length(c)).alias("n"), F.when(full, s["k"]).otherwise(s["k"] + 1).alias("k"), full.alias("full"))

    return F.slice(chunks, F.lit(1), F.aggregate(chunks, zero, step)["k"])


def trimmed_context(chunks: Column, question: Column, budget_tokens: int, tokens_of=lambda prompt: F.floor(F.length(prompt) / 2)) -> Column:
    """The context of the chunks that fit: at most two characters a token in all, then a prompt within the budget, one chunk at least.

    ``tokens_of`` estimates a prompt's tokens.
    """
    kept = within_budget(chunks, 2 * budget_tokens)
    joined = lambda n: F.array_join(F.slice(kept, F.lit(1), n), CONTEXT_JOIN)
    counts = F.reverse(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))))
    fits = F.filter(counts, lambda n: (n <= 1) | (tokens_of(rag_prompt(joined(n), question)) <= budget_tokens))
    return F.when(F.size(kept) == 0, "").otherwise(joined(F.element_at(fits, 1)))


def parse_qa(c: Column) -> Column:
    """The question and answer pairs in a model's JSON, fenced or not; null if it isn't an array of whole pairs."""
    pairs = F.from_json(strip_code_fence(c), QA_SCHEMA, {"mode": "PERMISSIVE"})
    whole = F.forall(pairs, lambda p: p.isNotNull() & p["question"].isNotNull() & p["answer"].isNotNull())
    return F.when(whole, pairs)


def find_subsequence(ids: Column, start: int, then: list[int]) -> Column:
    """The position (from 0) of the first ``start`` that ``then`` follows; -1 if none."""
    n = len(then) + 1
    wanted = F.array(*[F.lit(x) for x in (start, *then)])
    places = F.when(F.size(ids) > n - 1, F.sequence(F.lit(0), F.greatest(F.size(ids) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: F.slice(ids, i + 1, F.lit(n)) == wanted)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(-1))


def mask_labels(ids: Column, start: int, then: list[int]) -> Column:
    """struct(labels, assistant_found): ids with all before the answer ignored; the last of ``then`` stays."""
    at = find_subsequence(ids, start, then)
    labels = F.transform(ids, lambda x, i: F.when((at >= 0) & (i < at + len(then)), F.lit(IGNORED)).otherwise(x))
    return F.struct(labels.alias("labels"), (at >= 0).alias("assistant_found"))


def trainable(labels: Column, found: Column) -> Column:
    return found & F.exists(labels, lambda x: x != IGNORED)


def padded(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def history_line(role: Column, content: Column, epoch: Column, you: str = "Вы", bot: str = "Бот") -> Column:
    return F.concat(F.when(role == "user", you).otherwise(bot), F.lit(" ["), history_time(epoch), F.lit("]: "), content)
