"""Tokens of any length are found inside of names."""

from auditlake.operators.names import resolve_token


def test_short_and_long_tokens(spark):
    names = spark.createDataFrame([("A", "한국 삼성 전자", 2), ("B", "삼성물산", 1), ("C", "é", 3), ("D", "plain", 4)], "symbol string, name string, pos int")
    tokens = ["삼", "삼성", "삼성 전", "성물산", "é", "lai", "plain", "없음", "삼성물산 주식회사", None]
    got = {r.token: r.symbol for r in resolve_token(spark.createDataFrame([(t,) for t in tokens], "token string"), names).collect()}
    assert got == {"삼": "B", "삼성": "B", "삼성 전": "A", "성물산": "B", "é": "C", "lai": "lai", "plain": "D", "없음": "없음", "삼성물산 주식회사": "삼성물산 주식회사", None: None}
