"""Lines of few words are repeats like any other."""

from cohortlab.llm import line_dedup


def test_short_lines_go_from_the_second_on(spark):
    docs = [(i, f"text number {i} says this\n日本語の行\nReleased under the MIT License.") for i in range(3)] + [(3, "日本語の行"), (4, "日本語の行")]
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert left == {0: docs[0][1], **{i: f"text number {i} says this\n\n" for i in (1, 2)}, 3: "", 4: ""}
