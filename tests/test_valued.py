"""Which instances a comparison of parameter sets reads, and which of their values."""

from kalibra.sources import cdfx


def instance(label, values, size=""):
    return f"<SW-INSTANCE><SHORT-NAME>{label}</SHORT-NAME><SW-VALUE-CONT>{size}<SW-VALUES-PHYS>{values}</SW-VALUES-PHYS></SW-VALUE-CONT></SW-INSTANCE>"


def test_values_by_kind(spark):
    size = "<SW-ARRAYSIZE><V>2</V></SW-ARRAYSIZE>"
    parts = [
        instance("A_C", "<VT>on</VT><V>5</V>"), instance("B_C", "<V> </V><VT>off</VT>"), instance("C_C", ""), instance("D_CA", "<V>1</V><VT>x</VT><VT>y</VT>", size), instance("E_CA", "<V>1</V><V>2</V>", size),
        instance("F_CA", "<V>1</V>"), instance("G_CA", "<V>1</V>", "<SW-ARRAYSIZE><V> </V></SW-ARRAYSIZE>"), instance("H_T", "<VT>p</VT><V>3</V><V>4</V>"), instance("I_T", "<VT>p</VT>"), instance("Odd", "<V>7</V>"),
    ]
    texts = spark.createDataFrame([("f", "<X>" + "".join(parts) + "</X>")], "file string, text string")
    got = {r.label: list(r.vals) for r in cdfx.valued(cdfx.instances(texts)).collect()}
    assert got == {"A_C": ["5"], "B_C": ["off"], "D_CA": ["x", "y"], "E_CA": ["1", "2"], "H_T": ["3", "4"], "I_T": ["p"], "Odd": ["7"]}
