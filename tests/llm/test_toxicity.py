import random

import numpy as np
from helpers import ODD_TEXTS, crc, docs_frame, labels_schema, with_clashes

from marginscope.llm import queries
from marginscope.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, d in enumerate(b, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return row[-1]


def slow_near(terms, word):
    best = 0.0
    for t, w in terms.items():
        stem = t.rstrip("*")
        if len(stem) < (X.FUZZY_OPEN_FROM if t.endswith("*") else X.FUZZY_FROM):
            continue
        heads = [word[:k] for k in range(len(word) + 1)] if t.endswith("*") else [word]
        if any(distance(stem, h) <= 1 for h in heads):
            best = max(best, w)
    return best


def test_automaton_on_the_trie_equals_edit_distances():
    rnd = random.Random(1)
    word = lambda a, b: "".join(rnd.choice("abc") for _ in range(rnd.randint(a, b)))
    terms = {word(3, 9) + rnd.choice(("", "*")): float(rnd.randint(1, 9)) for _ in range(30)}
    trie = X.Trie(terms)
    for _ in range(4000):
        w = word(1, 11)
        near = slow_near(terms, w)
        assert trie.near(w) == near
        assert not near or trie.may_be_near(w)  # the filter loses nothing
        exact = max([v for t, v in terms.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)], default=0.0)
        assert trie.exact(w) == exact


def test_learns_words_and_beginnings():
    toxic = [(["the", "idiot", "of", f"stem{k:02d}x"], 1) for k in range(40)]
    clean = [(["the", "cat", "of", f"house{k}"], 0) for k in range(40)]
    terms = X.learn_terms(toxic + clean)
    trie = X.Trie(terms)
    assert trie.exact("idiot") > 0 and trie.exact("stem99y") > 0 and not trie.exact("the") and not trie.exact("house1")


def test_copies_have_one_vote():
    toxic = [(["chance", "words", "of", "one", "text"], 1)] * 50 + [([f"w{k}q", "idiot", f"v{k}"], 1) for k in range(30)]
    clean = [([f"u{k}", "plain", f"t{k}"], 0) for k in range(80)]
    terms = X.learn_terms(toxic + clean)
    assert X.Trie(terms).exact("idiot") and not X.Trie(terms).exact("chance")


def test_words_of_clean_documents_are_not_misspellings():
    terms = {"trash": 4.0, "moron": 5.0}
    clean = [["thrash", "plain"]] * 1 + [["plain"]] * 99
    fuzzy, harmless = X.learn_misspelling(terms, clean)
    trie = X.Trie(terms, fuzzy, harmless)
    assert trie.near("thrash") == 0 and harmless == {"thrash"}
    assert 0 < trie.near("trashh") < X.FUZZY_SHARE * 4 and trie.near("morron") == X.FUZZY_SHARE * 5
    assert not any(X.learn_misspelling(terms, [["thrash"]] * 3)[0][t] for t in ("trash",))


def test_misspelled_abuse_is_caught(spark):
    """Clean documents with misspelled lexicon terms put in; and the clean ones themselves."""
    from marginscope.llm import common

    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = X.fit_documents(docs, labels)
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").where("lang = 'en' and doc_id % 7 = 0").collect() if crc(r["doc_id"], 5) == 0]
    terms = sorted(t for t, f in model.fuzzy.items() if f >= 0.7 and len(t) >= 5 and t.isascii() and t.isalpha())
    rnd = random.Random(1)
    planted = []
    for t in clean:
        w = t.split(" ")
        for _ in range(max(4, len(w) // 25)):
            term = rnd.choice(terms)
            k = rnd.randrange(1, len(term))
            w.insert(rnd.randrange(len(w) + 1), rnd.choice((term[:k] + term[k + 1 :], term[: k + 1] + term[k:], term[:k] + "x" + term[k + 1 :])))
        planted.append(" ".join(w))
    assert len(clean) > 30
    assert (model.score(model.matcher(), planted) >= X.TOXIC).mean() > 0.9
    assert (model.score(model.matcher(), clean) >= X.TOXIC).mean() < 0.03


def test_context_separates_quotation_from_abuse():
    m = X.Matcher({"idiot": 5.0})
    def context(text):
        words = X.words_of(text)
        m.look_up(set(words))
        return m.spans(words)[0][4]
    abuse, plain, quoted = context("you are an idiot and you know it"), context("some idiot came along"), context('the word "idiot" is a term of abuse, he said')
    assert abuse > plain > quoted and quoted < 0.2
    misspelled = context("you idiiot")
    assert misspelled > 0.5 and not m.spans(X.words_of("you idiiot"))[0][3]


def test_features_do_not_depend_on_the_batch():
    texts = ["you idiot", None, "", "nothing here", "idi0t idiiot idiot stupid"]
    terms = {"idiot": 4.0, "stup*": 3.0}
    whole = X.Matcher(terms).features(texts)
    assert np.allclose(whole, np.concatenate([X.Matcher(terms).features([t]) for t in texts]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (crc(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    out = [(rows[x["doc_id"]]["predicted"], x["toxic"]) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if crc(x["doc_id"], 5) == 0]
    assert sum(a == b for a, b in out) / len(out) > 0.9


def test_odd_rows(spark):
    docs = with_clashes(docs_frame(spark, ODD_TEXTS), "score", "predicted")
    model = X.fit_documents(docs, spark.createDataFrame([], labels_schema()))
    assert docs.select(X.toxicity(docs, model).alias("s")).where("s < 0.01").count() == len(ODD_TEXTS)
    train = docs_frame(spark, [(i, "you idiot") for i in range(20)] + [(i, "kind words") for i in range(20, 40)])
    labels = spark.createDataFrame([(i, None, int(i < 20)) for i in range(40)] + [(3, 1, 0), (None, 1, 1)], labels_schema())
    model = X.fit_documents(train, labels)
    rows = docs.select(X.toxicity(docs, model).alias("s"), X.span_finder(model)("text").alias("h")).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r["s"] <= 1 for r in rows)
    assert docs_frame(spark, []).select(X.toxicity(docs, model)).count() == 0


def swapped(a, b):
    """Whether two neighbours swapped in one word give the other."""
    return any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))


def test_a_swap_is_one_error():
    rnd = random.Random(3)
    word = lambda a, b: "".join(rnd.choice("abcd") for _ in range(rnd.randint(a, b)))
    terms = {word(4, 9) + rnd.choice(("", "*")): 1.0 for _ in range(30)}
    trie = X.Trie(terms, swaps=True)
    met = 0
    for k in range(4000):
        w = word(2, 11)
        if k % 2:
            w = rnd.choice(list(terms)).rstrip("*")
            i = rnd.randrange(len(w) - 1)
            w = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
        want = set()
        for t in terms:
            heads = [w[:j] for j in range(len(w) + 1)] if t.endswith("*") else [w]
            if any(distance(t.rstrip("*"), h) <= 1 or swapped(t.rstrip("*"), h) for h in heads):
                want.add(t)
        assert trie.near_terms(w) == want
        assert not want or trie.may_be_near(w)
        met += bool(want)
    assert met > 1000


def test_digits_symbols_and_swaps_are_errors():
    m = X.Matcher({"idiot": 5.0, "stupid": 4.0, "scum": 4.0, "moro*": 3.0})
    for w in ("idi0t", "st*pid", "id1ot", "(st*pid),", "1diot", "$cum", "sc*m", "scvm", "scmu", "idoit", "m0ronic", "\"idi0t!\""):
        assert m.features([f"you are {w} and him"])[0, 0] > 0, w
    for w in ("id10ts", "3.14", "s2", "and/or", "x86", "e.g."):
        assert m.features([f"you are {w} and him"])[0, 0] == 0, w
    (words,) = m.split(["he said \"idi0t!\" idiot/scum e.g."])
    assert words == ["he", "said", '"', "idi0t", '"', "idiot", "scum", "e", "g"]


def test_one_clean_document_does_not_make_a_word_harmless():
    terms = {"trash": 4.0}
    one = [["thrash"]] + [["plain"]] * 999
    assert X.Trie(terms, *X.learn_misspelling(terms, one)).near("thrash") > 0
    # a harmless word does not cost the term its other misspellings
    often = [["thrash"]] * 50 + [["plain"]] * 950
    trie = X.Trie(terms, *X.learn_misspelling(terms, often))
    assert trie.near("thrash") == 0 and trie.near("trashh") > 0


def test_every_learned_term_is_found_misspelled(spark):
    """Each learned term with a digit, a symbol, a swap or another letter in it."""
    from marginscope.llm import common

    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = X.fit_documents(docs, labels)
    terms = sorted(t for t in model.terms if t.rstrip("*").isalpha())
    missed, planted = [], 0
    for t in terms:
        w = t.rstrip("*")
        for k in range(1, len(w) - 1):
            forms = {w[:k] + c + w[k + 1 :] for c in "0*x"} | {w[:k] + w[k + 1] + w[k] + w[k + 2 :]}
            for f in forms - {w}:
                planted += 1
                if not model.matcher().features([f"you {f} there"])[0, 0]:
                    missed.append((t, f))
    held_out = [r for r in docs.join(labels, "doc_id").collect() if crc(r["doc_id"], 5) == 0]
    clean, toxic = ([r["text"] for r in held_out if r["toxic"] == k] for k in (0, 1))
    caught = (model.score(model.matcher(), toxic) >= X.TOXIC).mean()
    wrong = (model.score(model.matcher(), clean) >= X.TOXIC).mean()
    print(f"{len(terms)} terms, {planted - len(missed)} of {planted} misspellings found; {wrong:.4f} of {len(clean)} clean and {caught:.4f} of {len(toxic)} toxic held-out documents called toxic; missed {missed[:20]}")
    assert len(missed) <= 0.05 * planted and wrong < 0.03


def test_model_fitted_in_a_task(spark):
    """The same model as from the same sample on the driver."""
    from marginscope.llm import common

    sf = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    here = X.fit(common.labelled_sample(docs, labels, "toxic", X.SAMPLE_PER_LABEL, X.SAMPLE_CHARS, folds=5, held_out=0))
    there = X.fit_documents(docs.repartition(5), labels)
    assert (there.terms, there.fuzzy, there.harmless) == (here.terms, here.fuzzy, here.harmless)
    assert abs(there.weights - here.weights).max() < 1e-9
