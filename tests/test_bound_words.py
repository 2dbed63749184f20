"""Words are bound once for each pair of word and definition."""

import contextlib
import io

import __spark_entry__ as entry


def test_documents_do_not_hash_their_words(spark, sf_dir):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        entry.queries()["lexicon_bind"](spark, sf_dir).explain()
    assert "md5" not in said.getvalue()
