import math
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calltally import values
from calltally.functions.stemmer import stem
from calltally.functions.subsequence import common_length
from calltally.functions import text
from calltally.operators import batch, judge, rules, text_scores
from calltally.plans.stems import stem_ctes
from tests.conftest import dicts


def plain_bleu(reference, candidate):
    """The published formula, one pair at a time."""
    r, c = reference.lower().split(), candidate.lower().split()
    if not c:
        return 0.0
    if r == c:
        return 1.0
    total, zeros = 0.0, 0
    for n in range(1, 5):
        cand = Counter(tuple(c[i : i + n]) for i in range(len(c) - n + 1))
        ref = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        top = sum(min(k, ref[g]) for g, k in cand.items())
        bottom = max(1, len(c) - n + 1)
        if n == 1 and top == 0:
            return 0.0
        if top == 0 and len(c) > 1:
            zeros += 1
            top = 1 / (2**zeros * 5 / math.log(len(c)))
        if top > 0:
            total += math.log(top / bottom) / 4
    return (1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c))) * math.exp(total)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def scored(spark, pairs, **options):
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(pairs)], "id bigint, prompt string, response string")
    return {r["id"]: r for r in text_scores.text_scores(df, "id", **options).collect()}


def test_bleu_goldens(spark):
    got = scored(
        spark,
        [
            ("The capital of France is Paris.", "Paris is the capital of France."),
            ("the cat sat on the mat", "the cat sat"),
            ("hello world", "completely unrelated text here"),
            ("Same  text", "same text"),
            ("anything", ""),
            ("", "some words"),
            ("one", "one two"),
            (None, None),
        ],
        rouge=False,
    )
    assert [round(got[i]["bleu"], 6) for i in range(8)] == [0.251198, 0.211795, 0.0, 1.0, 0.0, 0.0, pytest.approx(plain_bleu("one", "one two"), abs=1e-6), 0.0]


def test_bleu_and_rouge1_match_brute_force(spark):
    rng = random.Random(3)
    pairs = [
        (" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))), " ".join(rng.choice("abcdf") for _ in range(rng.randint(0, 15))))
        for _ in range(150)
    ]
    got = scored(spark, pairs, stemming=False)
    assert len(got) == len(pairs)
    for i, (r, c) in enumerate(pairs):
        assert got[i]["bleu"] == pytest.approx(plain_bleu(r, c), abs=1e-12)
        a, b = r.split(), c.split()
        met, lcs = sum((Counter(a) & Counter(b)).values()), plain_lcs(a, b)
        for name, value in (("rouge1", met), ("rougeL", lcs)):
            p, q = value / max(len(b), 1), value / max(len(a), 1)
            assert got[i][name] == pytest.approx(round(2 * p * q / (p + q), 4) if p + q else 0.0, abs=1.01e-4)


@pytest.mark.parametrize("options", [{"rouge": False}, {"bleu": False}, {}])
def test_exploded_grams_are_not_shuffled(spark, options, capsys):
    rows = spark.createDataFrame([(1, "a", "b")], "id bigint, prompt string, response string")
    text_scores.text_scores(rows, "id", **options).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_scores_stay_within_the_row(spark, capsys):
    rows = spark.createDataFrame([(1, "a", "b")], "id bigint, prompt string, response string")
    text_scores.text_scores(rows, "id").explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and plan.count("ArrowEvalPython") == 1


def test_repeated_grams_are_clipped_on_both_sides(spark):
    pairs = [("a a a b", "a a b b"), ("x 0 x 1", "x 1 x 0"), ("a b a b a b", "a b"), ("a b", "a b a b a b"), ("", "")]
    got = scored(spark, pairs, stemming=False)
    for i, (r, c) in enumerate(pairs):
        assert got[i]["bleu"] == pytest.approx(plain_bleu(r, c), abs=1e-12) if c else got[i]["bleu"] == 0.0
    assert [got[i]["rouge1"] for i in range(5)] == [0.75, 1.0, 0.5, 0.5, 0.0]


def test_rouge_goldens(spark):
    got = scored(
        spark,
        [("The capital of France is Paris.", "Paris is the capital of France."), ("Running quickly!", "runs quick"), ("", "x")],
        bleu=False,
    )
    assert (got[0]["rouge1"], got[0]["rougeL"]) == (1.0, 0.6667)
    assert got[1]["rouge1"] == 0.5
    assert (got[2]["rouge1"], got[2]["rougeL"]) == (0.0, 0.0)


def test_long_texts_are_scored_whole(spark):
    words = [f"w{i}" for i in range(20_000)]
    pair = (" ".join(words), " ".join(words[:-1] + ["other"]))
    got = scored(spark, [pair])[0]
    assert got["rougeL"] == round(19_999 / 20_000, 4) and 0.9999 < got["bleu"] < 1.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_common_length_matches_the_table(left, right):
    assert common_length(left, right) == plain_lcs(left, right)


# Pairs published with the algorithm, and the extensions for short and irregular words.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
    "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ",
    "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "skies": "sky",
    "dies": "die", "died": "die", "tried": "tri", "is": "is", "sky": "sky", "enjoy": "enjoy",
    "generalizations": "gener", "oscillators": "oscil",
}


def test_stems():
    assert {word: stem(word) for word in STEMS} == STEMS


def test_jaccard(spark):
    rows = [("", "", 1.0), ("a b", "", 0.0), ("A b", "b c", 1 / 3), (" x ", "X", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for row in df.withColumn("got", text_scores.jaccard(F.col("a"), F.col("b"))).collect():
        assert row["got"] == pytest.approx(row["want"])


def test_cosine_is_clamped(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([3.0, 4.0], [4.0, 3.0], 0.96), ([0.0], [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    for row in df.withColumn("got", text_scores.cosine(F.col("a"), F.col("b"))).collect():
        assert row["got"] == pytest.approx(row["want"])


def test_combined_rouge_variants(spark):
    row = spark.range(1).select(
        text_scores.combined_rouge(F.lit(1.0), F.lit(0.6666)).alias("mean"),
        text_scores.combined_rouge(F.lit(1.0), F.lit(0.6666), "rougeL").alias("last"),
    ).first()
    assert (row["mean"], row["last"]) == (pytest.approx(0.8333), 0.6666)
    with pytest.raises(ValueError):
        text_scores.combined_rouge(F.lit(1.0), F.lit(1.0), "median")


@pytest.mark.parametrize(
    "added,body,matches,score",
    [
        ([("hi", r"\bhello\b", 1.0), ("num", r"\d+", 2.0)], "Hello, there are 3 items", {"hi": True, "num": True}, 1.0),
        ([("code", "```", 1.0), ("url", "https?://", 1.0)], "look: ```x```", {"code": True, "url": False}, 0.5),
        ([], "anything", {}, 0.0),
        ([("table", r"\|.*\|", 1.0)], "no table here", {"table": False}, 0.0),
        ([("table", r"\|.*\|", 1.0)], "| a\nb |", {"table": True}, 1.0),
        ([("a", "x", 0.0)], "x", {"a": True}, 0.0),
        ([("upper", "ÉCOLE", 1.0), ("other", "q", 2.0)], "l'école", {"upper": True, "other": False}, 0.3333),
    ],
)
def test_rules(spark, added, body, matches, score):
    known = rules.RuleSet()
    for rule in added:
        known.add(*rule)
    df = spark.createDataFrame([(body,)], "text string")
    row = rules.evaluate_rules(df, known, "text").first()
    assert row["rule_matches"] == matches and row["weighted_score"] == score


def test_judge_prompt_and_key(spark):
    import hashlib

    row = spark.range(1).select(
        judge.judge_prompt(F.lit("P {x}"), F.lit("R"), F.lit("C")).alias("request"),
        text.content_key(F.lit("P"), F.lit("R"), F.lit("C")).alias("key"),
    ).first()
    assert row["request"] == values.JUDGE_TEMPLATE.format(criteria="C", prompt="P {x}", response="R")
    assert row["key"] == hashlib.sha256(b"P||R||C").hexdigest()


def test_judge_requests_fold_copies_and_skip_scored(spark):
    rows = spark.createDataFrame(
        [(3, "p", "same"), (1, "p", "same"), (2, "p", "other"), (4, "p", "done")], "id bigint, prompt string, response string"
    )
    cache = judge.judge_requests(rows.where("id = 4"), "id", criteria="c").select("content_key")
    got = judge.judge_requests(rows, "id", cache, criteria="c")
    assert sorted(r["id"] for r in got.collect()) == [1, 2]


def test_answers(spark):
    answers = [
        ('{"score": 8}', 0.8), ('{"score": 99}', 1.0), ('{"score": -5}', 0.0), ("not json", 0.0),
        ('{"points": 3}', 0.0), (None, 0.0), (' {"score": "7.5", "explanation": "ok"}\n', 0.75),
    ]
    df = spark.createDataFrame(answers, "answer string, want double")
    for row in judge.parse_answers(df, "answer").collect():
        assert row["score"] == pytest.approx(row["want"])
    long = spark.createDataFrame([("{}", "x" * 900)], "answer string, told string")
    assert len(judge.parse_answers(long, "answer", "told").first()["explanation"]) == 500


def test_evaluators(spark, make_calls):
    calls = make_calls([{"prompt": "a b", "response": "a b"}, {"prompt": "a", "response": "z"}])
    ids = spark.createDataFrame([(1,), (2,), (2,), (77,)], "id bigint")
    known = batch.Evaluators().register("fixed", batch.batch_evaluator(lambda rows: rows["id"] * 0 + 1.7))
    got = dicts(batch.evaluate_batch(calls, ids, ["bleu", "fixed", "mystery"], known))
    assert {(r["completion_id"], r["eval_type"]): r["score"] for r in got} == {
        (1, "bleu"): 1.0, (2, "bleu"): 0.0, (1, "fixed"): 1.0, (2, "fixed"): 1.0,
    }
    with pytest.raises(ValueError, match="unknown evaluator"):
        known.evaluate("mystery", calls)


def test_failing_score_counts_as_zero(make_calls):
    known = batch.Evaluators({"gaps": lambda rows: rows.where("id = 1").selectExpr("id", "0.5D AS score")})
    rows = make_calls([{}, {}]).selectExpr("id", "prompt", "response", "'' AS criteria")
    assert {r["id"]: r["score"] for r in known.evaluate("gaps", rows).collect()} == {1: 0.5, 2: 0.0}


def test_batch_progress(spark, make_evals):
    asked = spark.createDataFrame([("j1", 1), ("j1", 2), ("j2", 3)], "job_id string, id bigint")
    scores = make_evals([(1, "bleu", 0.1), (1, "rouge", 0.2), (3, "bleu", 0.3)])
    got = {r["job_id"]: (r["total"], r["done"], r["status"]) for r in batch.batch_progress(asked, scores).collect()}
    assert got == {"j1": (2, 1, "processing"), "j2": (1, 1, "complete")}
    known = spark.createDataFrame([(1,), (3,)], "id bigint")
    got = {r["job_id"]: (r["total"], r["done"], r["status"]) for r in batch.batch_progress(asked, scores, known).collect()}
    assert got == {"j1": (2, 2, "complete"), "j2": (1, 1, "complete")}


def test_raising_evaluators_score_zero(make_calls):
    def picky(rows):
        if (rows["id"] == 2).any():
            raise RuntimeError("no answer")
        return rows["id"] * 0.25

    def broken(rows):
        raise ValueError("not set up")

    known = batch.Evaluators({"picky": batch.batch_evaluator(picky), "broken": broken, **batch.BUILT_IN})
    calls = make_calls([{}, {}, {}])
    ids = calls.select("id")
    got = {(r["eval_type"], r["completion_id"]): r["score"] for r in batch.evaluate_batch(calls, ids, ["picky", "broken", "bleu"], known).collect()}
    assert {k: v for k, v in got.items() if k[0] != "bleu"} == {
        ("picky", 1): 0.25, ("picky", 2): 0.0, ("picky", 3): 0.75, ("broken", 1): 0.0, ("broken", 2): 0.0, ("broken", 3): 0.0,
    }
    assert len(got) == 9


def test_explanation_request_names_criteria_only_if_given(spark):
    rows = spark.createDataFrame([(1, "p", "r", "c"), (2, None, "r", ""), (3, "p", "r", None)], "id int, prompt string, response string, criteria string")
    got = {r["id"]: r["request"] for r in judge.explanation_requests(rows, "id").collect()}
    assert got[1].endswith("Prompt: p\nResponse: r\nCriteria: c") and got[2].endswith("Prompt: \nResponse: r")
    assert got[3].endswith("Response: r")


def test_two_rows_with_one_id_are_an_error(spark):
    rows = spark.createDataFrame([(1, "a b", "a c"), (1, "x", "y")], "id long, prompt string, response string")
    with pytest.raises(Exception, match="two rows with the id 1"):
        text_scores.text_scores(rows, "id").collect()


def test_stemmer_agrees_with_its_sql_steps():
    rng = random.Random(12)
    endings = "sses ies s eed ed ing ational izer alli ousli ization iveness biliti logi icate alize ful ness al ement ion e y ll".split()
    made = {
        "".join(rng.choice("aeioubcdlsty") for _ in range(rng.randrange(1, 6))) + rng.choice(endings) + rng.choice(["", rng.choice(endings)])
        for _ in range(4000)
    } | {"caresses", "skies", "dying", "relational", "hopping", "filing", "controll", "syzygy", "agreed"}
    connection = duckdb.connect()
    connection.execute("CREATE TABLE made AS SELECT unnest(?) AS word", [sorted(made)])
    got = dict(connection.execute(f"WITH {stem_ctes('made')} SELECT word, stem FROM stems").fetchall())
    assert got == {word: stem(word) for word in made if len(word) > 3}


def test_whitespace_matches_python(spark):
    samples = ["a\x1cb c  d", "　x ", "", " \t\n", "é\x85ü"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select("t", text.words(F.col("t")).alias("w"), text.strip(F.col("t")).alias("s")).collect()
    for row in got:
        assert row["w"] == row["t"].split() and row["s"] == row["t"].strip()


def test_token_estimates(spark):
    df = spark.createDataFrame([("",), ("one two three",), ("x" * 9,)], "t string")
    got = df.select(
        text.tokens_by_words(F.col("t")), text.tokens_by_chars(F.col("t")), text.tokens_as_words(F.col("t"))
    ).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (3, 3, 3), (1, 2, 1)]
