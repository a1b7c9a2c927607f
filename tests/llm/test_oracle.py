import pytest

from lodestone.llm import license_scan
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, data, name):
    same(QUERIES[name](spark, data), duck, ORACLE_SQL[name])


def test_licences_of_whole_files_and_heirs_equal_sql(spark, duck, tmp_path):
    """The standard pages hold headers alone; these hold whole texts, wrapped headers, and directories that inherit."""
    gpl = "\n".join(["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."])
    pages = []
    for i, (name, texts) in enumerate(sorted(license_scan.TEMPLATES.items())):
        pages += [(f"https://h.org/{i}/LICENSE", f"<p>Copyright (c) 20{i}4 Jo Doe</p>\n{texts[-1]}"), (f"https://h.org/{i}/src/", f"<h1>{name}</h1>"), (f"http://h.org/{i}/src/deep/x.py?q=1", "import os"), (f"http://h.org/{i}/own.c", f"<pre>{texts[0]}</pre> code")]
    pages += [("https://h.org/g/x.c", "/*\n * " + gpl.replace("\n", "\n * ") + "\n */\nint main;"), ("https://h.org/g/y.py", "# " + gpl.replace("\n", "\n# ") + "\nimport os\nimport json\n")]
    pages += [("https://h.org/", "Released under the MIT License."), ("https://i.org/a", "Copyright 2020 A. B. All rights reserved. More"), ("https://i.org/b", ""), (None, "All rights reserved."), (None, None), ("https://j.org/c", None)]
    pages += [(f"https://k.org/{i}", "licensed words of a page that says nothing of terms" if i % 3 else "plain") for i in range(60)]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["op8_license_scan"](spark, str(tmp_path))
    kinds = {r.origin: r["count"] for r in got.groupBy("origin").count().collect()}
    assert kinds["file"] == 9 and kinds["inherited"] >= 18 and kinds["header"] >= 13
    same(got, con, ORACLE_SQL["op8_license_scan"])
