import pytest
from pyspark.sql import functions as F

from prosegauge.lexicons import PRIMARY_STANCES, STANCES
from prosegauge.operators import evaluate as ev, stance as st, writer as wr
from prosegauge.plans.score_documents import score_documents

# Regression sentences with the primary stances they may get and the tags they must get.
CASES = [
    ("His batting is a masterclass in suspense... visionary, really.",
     {"SARCASTIC_ATTACK", "DIRECT_CRITICISM"}, {"SARCASTIC"}),
    ("Brilliant planning, right? Is this how modern aggression is supposed to look?",
     {"SARCASTIC_ATTACK", "MIXED_OR_AMBIGUOUS"}, {"RHETORICAL"}),
    ("Some analysts said role flexibility improved balance while others focused on strike rotation trends.",
     {"NEUTRAL_COMMENTARY", "MIXED_OR_AMBIGUOUS"}, {"REPORTED"}),
    ("A visionary innings again, because making boundaries optional is apparently elite modern strategy.",
     {"SARCASTIC_ATTACK", "DIRECT_CRITICISM"}, {"SARCASTIC"}),
    ("People say he is finished, but others believe his role changed and context matters now.",
     {"MIXED_OR_AMBIGUOUS", "NEUTRAL_COMMENTARY", "SUPPORTIVE_DEFENSE"}, {"REPORTED", "QUOTED"}),
]
# Sentences that set the sarcasm threshold.
TUNING = [
    ("His batting is a masterclass in suspense, visionary really, because nobody knows when runs arrive.", True),
    ("Brilliant tempo if the goal is to make boundaries an optional feature.", True),
    ("Some analysts prefer him opening while others value flexibility for team balance.", False),
    ("The criticism ignores his role change and improved game awareness this season.", False),
    ("Amazing intent, until you check the scoreboard and selection mistakes continue.", True),
]


def paras(frame, texts):
    return frame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, para_ix int, text string")


def test_sarcasm_regression(frame):
    got = st.stance_report(st.paragraph_stance(paras(frame, [t for t, _, _ in CASES]))).orderBy("doc_id").collect()
    for row, (text, allowed, tags) in zip(got, CASES):
        assert row.primary_stance_label in allowed, text
        assert tags <= set(row.style_tags), text


def test_threshold_tuning_finds_the_default(frame):
    scores = st.sarcasm(paras(frame, [t for t, _ in TUNING])).orderBy("doc_id").collect()
    assert [round(r.sarcasm_score, 2) for r in scores] == [0.55, 0.4, 0.0, 0.0, 0.6]
    cases = frame([(r.sarcasm_score, e) for r, (_, e) in zip(scores, TUNING)], "score double, expected boolean")
    assert ev.tune_threshold(cases).first().threshold == pytest.approx(0.35)


def test_quotes_and_attacks(frame):
    texts = [
        "People say he is useless, but that is wrong.",
        "People say he is overrated and they are right to call him pathetic.",
        "He is useless and pathetic.",
        "Not fair to judge on old numbers alone. He has evolved and context was different, still developing.",
        "   ",
    ]
    rows = st.stance_report(st.paragraph_stance(paras(frame, texts))).orderBy("doc_id").collect()
    assert rows[0].attack_rejection_detected and not rows[0].attack_endorsement_detected
    assert rows[1].attack_endorsement_detected and rows[1].stance_label == "DIRECT_ATTACK"
    assert rows[2].stance_label == "DIRECT_ATTACK" and rows[2].primary_stance_label == "DIRECT_CRITICISM"
    assert rows[3].fairness_defense_score == 1.0
    assert rows[4].stance_label == "NEUTRAL_ANALYSIS" and rows[4].sarcasm_gate_reason == "empty_text"


def test_probabilities_sum_to_one(frame):
    out = st.paragraph_stance(paras(frame, [t for t, _, _ in CASES] + ["plain words", ""]))
    sums = out.select(sum((F.col(st.prob(s)) for s in STANCES), F.lit(0.0)).alias("a"),
                      sum((F.col(st.primary_prob(s)) for s in PRIMARY_STANCES), F.lit(0.0)).alias("b")).collect()
    assert all(abs(r.a - 1) < 1e-3 and abs(r.b - 1) < 1e-3 for r in sums)


def test_document_stance_weights_and_tags(frame):
    df = frame([(1, 1, "He is useless and pathetic."), (1, 2, "The role was different. Because of that he has evolved.")],
               "doc_id int, para_ix int, text string")
    doc = st.document_stance(st.paragraph_stance(df)).first()
    para = {r.para_ix: r for r in st.paragraph_stance(df).collect()}
    w1, w2 = para[1].weight, para[2].weight
    mean = (w1 * para[1].prob_direct_attack + w2 * para[2].prob_direct_attack) / (w1 + w2)
    assert doc.n_paragraphs == 2 and doc.sarcasm_gate_reason == "paragraph_aggregated"
    assert doc.prob_direct_attack == pytest.approx(mean, abs=1e-3)


def test_writer_type(frame):
    docs = frame([(1, "because therefore evidence data strategy"), (2, "we our support the fans"), (3, "  ")],
                 "doc_id int, text string")
    got = {r.doc_id: r for r in wr.writer_type(docs).collect()}
    assert got[1].writer_type == "Analyst" and got[2].writer_type == "Passionate Fan"
    assert got[3].writer_type == "All-Rounder" and got[3].prob_all_rounder == 1.0


def test_score_documents_invariants(frame):
    docs = frame([
        (1, "The team should rotate the strike because dot balls caused the collapse. Therefore the plan can improve.\n\n"
            "However, we believe in the team balance and role clarity."),
        (2, ""),
        (3, "He is a fraud, an idiot and a disgrace to cricket."),
        (4, "Same script. Nothing changes every week."),
    ], "doc_id bigint, text string")
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    assert len(got) == 4 and all(20.0 <= r.final_score <= 95.0 for r in got.values())
    assert got[2].writing_quality_component == -7.0 and got[2].constructiveness == 0.0
    assert got[3].ceiling == 25.0 and got[3].final_score <= 25.0
    assert got[4].ceiling == 40.0
    assert got[1].final_score > got[4].final_score
    again = {r.doc_id: r for r in score_documents(docs.repartition(5)).collect()}
    assert again == got


def test_searched_texts_are_those_that_can_match(frame):
    from prosegauge.functions import text as tx
    from prosegauge.lexicons import NEEDED, PATTERNS

    found = ["not performing", "ignored", "mistake", "slow", "dropped"]
    texts = [f"{a} {b} {x}" for a in ("masterclass", "legendary", "visionary", "plain") for b in ("but", "and") for x in [*found, "really", "kept"]]
    low = F.col("t")
    checked = [F.struct(tx.regex_any(low, PATTERNS[n]), tx.regex_any_with(low, PATTERNS[n], NEEDED[n])) for n in NEEDED]
    rows = frame([(t,) for t in [*texts, None, ""]], "t string").select(*checked).collect()
    assert all(a == b for row in rows for a, b in row) and all(any(row[i][0] for row in rows) for i in range(len(NEEDED)))
