"""Languages and scripts that were never learned are rejected, those that were are not."""

from pyspark.sql import functions as F

from trailmark.llm import language_id

SF = "/root/testdata/sf0.01"
STRANGE = [
    "Η αναφορά της επιτροπής διαβάστηκε το πρωί της δεύτερης ημέρας και κανείς δεν είχε να προσθέσει κάτι",
    "Доклад комитета был прочитан утром второго дня, и никто ничего не добавил",
    "委員会の報告は二日目の朝に読まれ 誰も何も付け加えなかった",
    "समिति की रिपोर्ट दूसरे दिन सुबह पढ़ी गई",
    "Καλημέρα",
]


def test_a_script_that_was_never_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.train_part(docs, 5))
    strange = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(STRANGE)], "doc_id bigint, text string")
    assert [r.rejected for r in language_id.predict(strange, model).collect()] == [True] * len(STRANGE)
    assert language_id.accepted(strange, model).count() == 0
    usual = docs.where(language_id.fold_column(F.col("doc_id"), 5) == 0).where("length(text) > 20")
    assert language_id.predict(usual, model).where("rejected").count() <= 0.02 * usual.count()
