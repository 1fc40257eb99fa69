import numpy as np
import pytest

from attestra.llm import moderation as K


@pytest.fixture(scope="module")
def examples(spark, data):
    rows = spark.read.parquet(f"{data}/moderation_example.parquet").dropna(subset=["text", "category"]).orderBy("example_no").collect()
    return [r["text"] for r in rows], [r["category"].strip().lower() != "none" for r in rows]


@pytest.fixture(scope="module")
def tagger(examples):
    return K.train_tagger(*examples)


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("іdіоt", "idiot"), ("i​diot", "idiot"), ("n-aked", "naked"), ("idiiiiot", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("Idióts", "idiots"), ("f u c k", "fuck"), ("sh!t", "shit"), ("i**ot", "idiot")])
def test_spelling_tricks(token, word):
    assert [w for w, _ in K.Lexicon().canonical(token)] == [word]


def test_plain_words_stay(tagger):
    assert [w for w, _ in K.Lexicon().canonical("top-level")] == ["top", "level"]
    assert [w for w, _ in K.Lexicon().canonical("Версия")] == ["версия"]


def forms(texts):
    """For each text the number of its form: texts that hold near-equal segments have one form."""
    lexicon, owner, parsed = K.Lexicon(), [], []
    for i, text in enumerate(texts):
        found = K.segments(text, lexicon)
        parsed += found
        owner += [i] * len(found)
    form, first = list(range(len(texts))), {}

    def top(i):
        while form[i] != i:
            i = form[i]
        return i

    for i, head in zip(owner, K.near_equal_groups(parsed)):
        form[top(i)] = top(first.setdefault(head, i))
    return [top(i) for i in range(len(texts))]


def test_accuracy_on_forms_that_training_never_saw(examples):
    texts, toxic = examples
    form = forms(texts)
    order = {f: k % 4 for k, f in enumerate(sorted(set(form)))}
    guess, truth = [], []
    for fold in range(4):
        train = [i for i in range(len(texts)) if order[form[i]] != fold]
        tagger = K.train_tagger([texts[i] for i in train], [toxic[i] for i in train])
        for i in range(len(texts)):
            if order[form[i]] == fold:
                guess.append(tagger.score(texts[i])[0] >= K.THRESHOLD)
                truth.append(toxic[i])
    guess, truth = np.array(guess), np.array(truth)
    precision, recall = (guess & truth).sum() / guess.sum(), (guess & truth).sum() / truth.sum()
    assert precision > 0.92 and recall > 0.85  # some labels of the sample are wrong


def test_near_equal_segments_have_one_head():
    lexicon = K.Lexicon()
    parsed = [K.segments(t, lexicon)[0] for t in ("You are a stupid idiot and a liar.", "You are a dumb idiot and a liar.", "Kill the zombie process.")]
    heads = K.near_equal_groups(parsed)
    assert heads[0] == heads[1] != heads[2]


def test_segments_without_an_offending_word_are_left_out_and_long_ones_stay_whole():
    lexicon = K.Lexicon()
    assert K.segments("The build is fine. All is well", lexicon) == [] and K.segments("", lexicon) == []
    found = K.segments("word " * 500 + "idiot " + "word " * 500, lexicon)
    assert len(found) == 1 and len(found[0]) == 1001


def test_words_inside_runs_without_blanks_are_found():
    words = [w for w, c in K.Lexicon().canonical("お前は本当に馬鹿だ") if c]
    assert words == ["お前", "馬鹿"]


def test_marked_sentences_label_their_spans():
    marked = K.marked_sentences()
    assert all("[" not in t and "]" not in t for t, _ in marked) and all(0 <= s[0] < s[1] <= len(t) for t, s in marked if s)


@pytest.mark.parametrize(
    "text, toxic",
    [
        ("You are a stupid idiot and everybody knows it.", True), ("The parser dies on garbage input.", False), ("Posts that call people an idiot are removed by the moderators.", False),
        ("My stupid mistake, I forgot to close the file.", False), ("All immigrants are vermin and belong in a cage.", True), ("Send me your naked pics, I want you in my bed.", True),
        ("The study followed women with breast cancer.", False), ("Du bist ein dummer Versager, halt die Fresse.", True),
    ],
)
def test_context_decides(tagger, text, toxic):
    assert (tagger.score(text)[0] >= K.THRESHOLD) == toxic


def test_marginals_are_those_of_all_paths(tagger):
    segment = K.segments("Go away, you stupid idiot", tagger.lexicon)[0]
    emissions, chain = tagger.field.emissions(segment), tagger.field.chain
    n, total, clean, marks = len(segment), 0.0, 0.0, np.zeros(len(segment))
    for path in range(2**n):
        y = [path >> i & 1 for i in range(n)]
        score = (chain[0] if y[0] else 0.0) + sum(e for e, v in zip(emissions, y) if v)
        score += sum({(0, 1): chain[1], (1, 0): chain[2], (1, 1): chain[3]}.get((a, b), 0.0) for a, b in zip(y, y[1:]))
        weight = np.exp(score)
        total += weight
        clean += weight if not path else 0.0
        marks += weight * np.array(y)
    probability, marginals = tagger.field.marginals(segment)
    assert probability == pytest.approx(1 - clean / total, abs=1e-9) and marginals == pytest.approx(marks / total, abs=1e-9)


def test_spans_are_places_in_the_text(tagger):
    text = "The build is fine.​ Shut up, you w­orthless idiot. The docs are fine."
    score, spans = tagger.score(text)
    assert score > 0.5 and len(spans) == 1
    assert "idiot" in text[spans[0][0] : spans[0][1]] and "docs" not in text[spans[0][0] : spans[0][1]]


def test_rows(spark, tagger):
    rows = [(1, None, "s", 0.5), (2, "", "s", 0.5), (3, " \n", None, 0.5), (4, "You idiot, go to hell!", "s", 0.5), (4, "You idiot, go to hell!", "s", 0.5), (None, "fine", "s", 0.5), (5, "fine words. " * 20000 + "You stupid idiot!", "s", 0.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    got = sorted(((r["doc_id"] or 0), r["score"] >= K.THRESHOLD, bool(r["spans"])) for r in K.score_texts(df, "doc_id", "text", tagger, keep=("source",)).collect())
    assert got == [(0, False, False), (1, False, False), (2, False, False), (3, False, False), (4, True, True), (4, True, True), (5, True, True)]
    assert K.score_texts(df.filter("doc_id = 77"), "doc_id", "text", tagger).count() == 0


def test_segments_without_an_offending_word_are_scored_too():
    """Words that only the sample shows to be toxic belong to no class."""
    texts = [f"{a} {b} flumox grendle {c}" for a in ("one", "two", "six") for b in ("is", "was") for c in ("today", "here", "now")]
    clean = [f"{a} {b} garden table {c}" for a in ("one", "two", "six") for b in ("is", "was") for c in ("today", "here", "now")]
    tagger = K.train_tagger((texts + clean) * 3, ([True] * len(texts) + [False] * len(clean)) * 3)
    assert K.segments("five is flumox grendle then", tagger.lexicon) == []
    assert tagger.score("five is flumox grendle then")[0] >= K.THRESHOLD > tagger.score("five is garden table then")[0]


def test_quick_scores_are_those_of_the_features(tagger, examples):
    for text in [*examples[0][:150], "word " * 30 + "you idiot " + "word " * 400]:
        for segment in K.segments(text, tagger.lexicon, every=True):
            assert tagger.field.quick_emissions(segment) == pytest.approx(tagger.field.emissions(segment), abs=1e-9)
            assert tagger.field.probability(tagger.field.emissions(segment)) == pytest.approx(tagger.field.marginals(segment)[0], abs=1e-9)
