"""Total parsers, which give a tree for any input, and a query language over the trees."""

from arborlake.syntax.code import parse_code
from arborlake.syntax.html import parse_html
from arborlake.syntax.json import parse_json
from arborlake.syntax.sql_tree import GROUPS, parse_sql_tree

#: language: parser of bytes to a root Node.
LANGUAGES = {"json": parse_json, "html": parse_html, "sql": parse_sql_tree, "javascript": parse_code, "css": parse_code, "code": parse_code}

_CODE = frozenset("program block arguments brackets comment string number identifier literal".split())
#: language: the kinds of its named nodes, supertypes included.
KINDS = {
    "json": frozenset("document object array pair string string_content escape_sequence number true false null comment _value".split()),
    "html": frozenset("document doctype comment element script_element style_element start_tag end_tag self_closing_tag erroneous_end_tag erroneous_end_tag_name tag_name attribute attribute_name attribute_value quoted_attribute_value text entity raw_text".split()),
    "sql": frozenset("source_file statement keyword identifier quoted_identifier string number parameter comment parenthesis batch_separator".split()) | GROUPS,
    "javascript": _CODE,
    "css": _CODE,
    "code": _CODE,
}
#: language: the names of its fields.
FIELDS = {
    "json": frozenset(["key", "value"]),
    "html": frozenset(),
    "sql": frozenset("name value alias arguments window right left operand operator condition".split()),
    "javascript": frozenset(["name"]),
    "css": frozenset(["name"]),
    "code": frozenset(["name"]),
}
