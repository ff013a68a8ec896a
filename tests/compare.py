"""Rows of a query and of its SQL, in one order and with floats rounded."""

import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def rows(pdf):
    def cell(x):
        if x is None or x != x and not isinstance(x, str):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(cell(x) for x in r) for r in pdf.itertuples(index=False, name=None))


def oracle(sql, data=DATA):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con.execute(sql).df()
