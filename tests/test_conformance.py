import itertools

import pytest

from strandlog import conformance
from strandlog.sources.files import HadoopFiles
from strandlog.sources.store import FileStore


@pytest.mark.parametrize("kind", ["local", "hadoop"])
@pytest.mark.parametrize("name,case", list(conformance.cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_file_store(spark, tmp_path, name, case, kind):
    numbers = itertools.count()
    files = HadoopFiles(spark) if kind == "hadoop" else None
    case(lambda schema, **options: FileStore(f"{'file://' if kind == 'hadoop' else ''}{tmp_path}/{next(numbers)}", schema, files=files, **options))
