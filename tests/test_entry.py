"""Every registered query of the reference's operators against its SQL twin."""

import pytest

import __spark_entry__ as entry
from codesieve.plans.oracle import ORACLE
from codesieve.plans.queries import QUERIES
from conftest import SF
from oracle_check import compare

# No line of the smallest tables holds a credential, and no text is large enough.
EMPTY_HERE = {"secrets_in_documents", "secrets_in_pages", "rules_json_large", "scan_distinct"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, "/root/testdata/sf0.01" if name in EMPTY_HERE else SF, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 500


def test_names():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
