import os

import pytest

from cinderlake.plans import registry

from .against_sql import TABLES, same_rows

#: Rows that these need don't occur in the smallest tables.
RARE = {"text_encoded_blob", "config_secret", "lock_offregistry", "snapshot_diff"}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql().keys() - RARE))
def test_query_equals_its_sql(spark, name):
    same_rows(spark, registry.queries()[name], registry.oracle_sql()[name])
