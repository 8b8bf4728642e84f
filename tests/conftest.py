import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proofloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def elements(spark):
    """Build an elements table from ``(doc_id, type, content[, level])`` tuples in order."""
    def build(*rows):
        out, seen = [], {}
        for doc, kind, content, *level in rows:
            i = seen.get(doc, 0)
            seen[doc] = i + 1
            out.append((doc, i, kind, level[0] if level else (1 if kind == "heading" else 0), content, "Normal", {},
                        ("宋体", "", 12.0, False), ("justify", "single", 1.0), 0.0))
        return spark.createDataFrame(out, (
            "doc_id long, element_index int, element_type string, level int, content string, style_name string, metadata map<string,string>, "
            "font struct<font_name_cn:string,font_name_en:string,font_size_pt:double,bold:boolean>, "
            "para struct<alignment:string,line_spacing_type:string,line_spacing_value:double>, first_indent_twips double"))

    return build
