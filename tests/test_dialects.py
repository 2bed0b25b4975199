import pytest

from arborlake.functions.types import UnknownType, spark_type
from arborlake.plans.dialects import NotRewritten, to_spark


def test_texts():
    assert to_spark("select a from 'x/y.csv'") == "SELECT a FROM csv.`x/y.csv`"
    assert to_spark('select "a b", [1, 2][1] from t') == "SELECT `a b`, array(1, 2)[1] FROM t"
    assert to_spark("select x from t where y = 'é' -- c\n; drop table t") == "SELECT x FROM t WHERE y = 'é'"


@pytest.mark.parametrize("text", ["select * from a asof join b on a.t >= b.t", "select * from a positional join b", "select top 5 percent x from t", "select x from t limit 5 percent"])
def test_refused(text):
    with pytest.raises(NotRewritten):
        to_spark(text)


def test_types():
    for a, b in {"int unsigned": "bigint", "INTEGER ARRAY": "array<int>", "DECIMAL(76, 2)": "string", "Decimal64(4)": "decimal(18,4)", "timestamp(3) with time zone": "timestamp", "Map(String, Array(Nullable(UInt8)))": "map<string,array<smallint>>"}.items():
        assert spark_type(a) == b
    with pytest.raises(UnknownType):
        spark_type("no such type")


def test_escapes_and_marks():
    from arborlake.plans.dialects import odbc, outer_marks

    assert odbc("SELECT {fn length({fn upper('{d 1}')})}, {t '10:00:00'} WHERE a LIKE 'x!%' {escape '!'}") == "SELECT length(upper('{d 1}')), TIME '10:00:00' WHERE a LIKE 'x!%' ESCAPE '!'"
    assert outer_marks("SELECT 1 FROM a, b x WHERE a.k = x.k (+)") == "SELECT 1 FROM a LEFT JOIN b x ON a.k = x.k "
    for bad in ("SELECT 1 FROM a, b WHERE a.k(+) = b.k(+)", "SELECT 1 FROM a JOIN b ON a.k = b.k(+)"):
        with pytest.raises(NotRewritten):
            outer_marks(bad)


def test_procedures(spark):
    from arborlake.plans.dialects import Procedures

    own = Procedures(spark)
    own.create("CREATE PROCEDURE f(a INT, b STRING DEFAULT 'x, y') AS BEGIN SELECT a + 1 AS n, b AS t; END;")
    assert [tuple(r) for r in own.call("CALL f(2)").collect()] == [(3, "x, y")] and own.call("EXEC f(b => 'z', a => (1 + 1))").first().t == "z"
    for bad in ("CALL g(1)", "CALL f()", "CALL f(1, 'a', 2)", "CALL f(1, c => 2)"):
        with pytest.raises(NotRewritten):
            own.call(bad)
