"""Runs of lines that match a licence, against every run of every text."""

import random

from pyspark.sql import functions as F

from skilltide.llm import licenses

TEMPLATES = [("one", "a b c d e f g h"), ("two", "c d e f x y z a b"), ("three", "p q r s t u v w a b c d")]
THRESHOLD = 0.6


def texts(seed):
    """Lines of templates, whole and damaged, repeated and mixed with others; empty lines too."""
    draw = random.Random(seed)
    for n in (0, 1, 6, 14, 40):
        lines = []
        while len(lines) < n:
            words = draw.choice(TEMPLATES)[1].split()
            at = draw.randrange(len(words))
            lines += [" ".join(words[:at]), " ".join(words[at:])]
            lines += draw.choice([[], ["other words here"], ["", "a b"], ["k l m n", "k l m n"]])
        yield "\n".join(lines)


def grams(words):
    return set(zip(words, words[1:]))


def every_run(text):
    """(license, dice) of the runs that stay."""
    lines = [words for words in (line.split() for line in text.split("\n")) if words]
    runs = []
    for number, (name, template) in enumerate(TEMPLATES):
        wanted = grams(template.split())
        for start in range(len(lines)):
            # a run begins with a bigram that begins in its first line
            words = lines[start] + (lines[start + 1][:1] if start + 1 < len(lines) else [])
            if not grams(words) & wanted:
                continue
            best = (0.0,)
            for end in range(start, len(lines)):
                held = grams([w for line in lines[start:end + 1] for w in line])
                dice = 2 * len(held & wanted) / (len(held) + len(wanted))
                score = dice * len(held & wanted)
                if dice >= THRESHOLD and score > best[0]:
                    best = (score, dice, -number, -start, start, end, name)
            if len(best) > 1:
                runs.append(best)
    kept = []
    for run in sorted(runs, reverse=True):
        if all(run[5] < k[4] or k[5] < run[4] for k in kept):
            kept.append(run)
    return sorted((k[6], round(k[1], 9)) for k in kept)


def test_runs_of_random_lines(spark):
    made = [t for seed in range(6) for t in texts(seed)]
    rests = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").select(
        "doc_id", F.lit("k").alias("text_key"), F.lit(0).alias("rest"), "text")
    table = licenses._template_grams(spark, TEMPLATES)
    got = {}
    for r in licenses._windows(rests, table, THRESHOLD).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], round(r["dice"], 9)))
    want = {i: every_run(t) for i, t in enumerate(made)}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert sum(map(len, want.values())) > 50


def test_one_text_of_many_notices(spark):
    """Every notice between different lines of code is found."""
    notices = 400
    notice = next(text for name, text in licenses.TEMPLATES if name == "MIT" and len(text) > 600)
    words = notice.split()
    lines = [" ".join(words[i:i + 9]) for i in range(0, len(words), 9)]
    text = "\n".join("\n".join([*(f"int{i} value{i}{j} = call{i}{j}(x{i}{j}, y{j}{i});" for j in range(12)), *lines])
                     for i in range(notices))
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["licenses"], row["n_matches"]) == ("MIT", notices)
