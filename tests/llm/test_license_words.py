"""Weights of words outside the templates come from the corpus, too."""

from quillon.llm.license_scan import license_scan


def test_common_words_beside_a_statement(spark):
    rows = [(k, f"d{k}/x.txt", f"a la de el word{k}") for k in range(60)]
    rows += [(100, "s/x.txt", "a la de el Released under the MIT License."), (101, "t/x.txt", "one two three four Released under the MIT License.")]
    got = {r.doc_id: (r.license, r.how) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[100] == ("MIT", "own")
    # words as rare as the statement's own weigh as much as they did
    assert got[101] == (None, None)
    assert not any(got[k][0] for k in range(60))
