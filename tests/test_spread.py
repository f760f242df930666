"""Steps that cost far more than moving their rows run on all cores, and what a process holds isn't sent."""

import pickle

import pytest

from quire.plans import registry
from quire.sources import crypt

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["convert_pdf", "open_texts", "pdf_archived", "pdf_fonts", "pdf_forms_filled", "pdf_password", "pdf_rendered", "pdf_signatures", "pdf_spacing", "pdf_tables", "pipeline_pdf_only", "pipeline_steps", "office_round_trip", "pptx_text"])
def test_files_of_one_small_table_are_made_by_all_cores(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan


def test_linked_and_plain_rc4():
    for n in (1, 5, 16, 32):
        key = bytes(range(7, 7 + n))
        assert crypt.rc4(key, b"some text" * 9) == crypt.rc4(key, b"some text" * 9, plain=True)
    assert crypt.rc4(b"Key", b"Plaintext", plain=True).hex() == "bbf316e8d940af0ad3"


def test_library_is_looked_up_once_and_never_sent(monkeypatch):
    crypt.cbc(bytes(16), bytes(16), bytes(16), True)
    monkeypatch.setattr(crypt, "_library", lambda: pytest.fail("looked up again"))
    crypt.cbc(bytes(16), bytes(16), bytes(16), True)
    assert pickle.loads(pickle.dumps(crypt._held)).made == {}
