from fragmill.llm import pii


def test_secret_after_a_colon():
    for text in ("the password: hunter2xyz is old", "api_key: 'q8w7e6r5t4'"):
        assert "=" not in text
        (found,) = pii.candidates(text, pii.base_spans(text))
        assert (pii.KINDS[found[1]], text[found[0] : found[2]]) == ("secret", text.split(": ")[1].split()[0].strip("'"))


def test_secret_after_a_colon_is_masked(spark):
    rows = [(i, f"note {i} password: hunter{i}xyz end") for i in range(40)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert {r.doc_id: r.masked for r in got} == {i: f"note {i} password: <SECRET> end" for i, _ in rows}
