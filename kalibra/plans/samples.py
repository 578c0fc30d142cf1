"""Small inputs written for the format queries and tests."""

from __future__ import annotations

DESCRIPTOR = r'''
/begin PROJECT demo "sample // not a comment"
  /begin MODULE m ""
    /begin MOD_COMMON "" BYTE_ORDER MSB_LAST /end MOD_COMMON
    /begin RECORD_LAYOUT L_UB FNC_VALUES 1 UBYTE ROW_DIR DIRECT /end RECORD_LAYOUT
    /begin RECORD_LAYOUT L_SW FNC_VALUES 1 SWORD COLUMN_DIR DIRECT /end RECORD_LAYOUT
    /begin RECORD_LAYOUT L_F4 FNC_VALUES 1 FLOAT32_IEEE ROW_DIR DIRECT /end RECORD_LAYOUT
    /begin RECORD_LAYOUT L_AX AXIS_PTS_X 1 UWORD INDEX_INCR DIRECT /end RECORD_LAYOUT
    /begin COMPU_METHOD c_lin "" LINEAR "%5.2" "V" COEFFS_LINEAR 0.5 -10 /end COMPU_METHOD
    /begin COMPU_METHOD c_rat "" RAT_FUNC "%5.2" "rpm" COEFFS 0 2 4 0 3 0 /end COMPU_METHOD
    /begin COMPU_METHOD c_verb "" TAB_VERB "%1.0" "" COMPU_TAB_REF t_verb /end COMPU_METHOD
    /begin COMPU_METHOD c_intp "" TAB_INTP "%1.0" "K" COMPU_TAB_REF t_intp /end COMPU_METHOD
    /begin COMPU_VTAB t_verb "" TAB_VERB 2 0 "off" 1 "on" DEFAULT_VALUE "other" /end COMPU_VTAB
    /begin COMPU_TAB t_intp "" TAB_INTP 2 0 100 10 200 /end COMPU_TAB
    /begin AXIS_PTS ax "" 0x1020 N L_AX 0 c_lin 3 0 100 /end AXIS_PTS
    /begin CHARACTERISTIC K_lin_C "a \"quoted\" text" VALUE 0x1000 L_UB 0 c_lin 0 255 /end CHARACTERISTIC
    /begin CHARACTERISTIC K_rat_C "" VALUE 0x1001 L_UB 0 c_rat 0 255 /end CHARACTERISTIC
    /begin CHARACTERISTIC K_on_C "" VALUE 0x1002 L_UB 0 c_verb 0 255 /end CHARACTERISTIC
    /begin CHARACTERISTIC K_odd_C "" VALUE 0x1003 L_UB 0 c_verb 0 255 /end CHARACTERISTIC
    /begin CHARACTERISTIC K_arr_CA "" VAL_BLK 0x1004 L_SW 0 NO_COMPU_METHOD -9 9 MATRIX_DIM 3 1 1 /end CHARACTERISTIC
    /begin CHARACTERISTIC K_crv_T "" CURVE 0x1010 L_UB 0 c_intp 0 255
      /begin AXIS_DESCR COM_AXIS N c_lin 3 0 100 AXIS_PTS_REF ax /end AXIS_DESCR /end CHARACTERISTIC
    /begin CHARACTERISTIC K_map_M "" MAP 0x1014 L_UB 0 NO_COMPU_METHOD 0 255
      /begin AXIS_DESCR STD_AXIS N c_lin 2 0 1 /end AXIS_DESCR /begin AXIS_DESCR STD_AXIS N c_lin 3 0 1 /end AXIS_DESCR /end CHARACTERISTIC
    /begin CHARACTERISTIC K_flt_C "" VALUE 0x11000 L_F4 0 NO_COMPU_METHOD 0 1 /end CHARACTERISTIC
    /begin CHARACTERISTIC K_gap_C "" VALUE 0x5000 L_UB 0 c_lin 0 1 /end CHARACTERISTIC
    /begin CHARACTERISTIC K_non_C "" VALUE 0x1000 L_none 0 c_lin 0 1 /end CHARACTERISTIC
    /begin FUNCTION FnOne "" FUNCTION_VERSION "1.2" /begin DEF_CHARACTERISTIC K_lin_C K_arr_CA /end DEF_CHARACTERISTIC /end FUNCTION
    /begin FUNCTION FnTwo "" FUNCTION_VERSION "3" /begin DEF_CHARACTERISTIC K_map_M K_lin_C /end DEF_CHARACTERISTIC /end FUNCTION
  /end MODULE
/end PROJECT
'''


def hex_line(kind: int, offset: int, data: bytes) -> str:
    body = bytes([len(data), offset >> 8, offset & 255, kind]) + data
    return ":" + (body + bytes([-sum(body) & 255])).hex().upper()


def image() -> str:
    first = bytes([60, 10, 1, 7]) + (5).to_bytes(2, "little") + (-2).to_bytes(2, "little", signed=True) + (300).to_bytes(2, "little")
    curve_and_map = bytes([0, 5, 20, 0, 1, 2, 3, 4, 5, 6])
    axis = b"".join(v.to_bytes(2, "little") for v in (20, 40, 60))
    lines = [
        hex_line(4, 0, b"\0\0"),
        hex_line(0, 0x1000, first),
        hex_line(0, 0x1010, curve_and_map),
        hex_line(0, 0x1020, axis),
        hex_line(4, 0, b"\0\1"),
        hex_line(0, 0x1000, bytes.fromhex("0000C03F")),
        hex_line(1, 0, b""),
    ]
    return "\n".join(lines) + "\n"


def container(rows: str) -> str:
    return f'<?xml version="1.0"?>\n<!DOCTYPE MSRSW>\n<MSRSW><SW-INSTANCE-SPEC><SW-INSTANCE-TREE>\n{rows}\n</SW-INSTANCE-TREE></SW-INSTANCE-SPEC></MSRSW>\n'


def instance(label: str, values: str, axes: str = "", unit: str = "V", size: str = "") -> str:
    size = f"<SW-ARRAYSIZE><V>{size}</V></SW-ARRAYSIZE>" if size else ""
    return (
        f"<SW-INSTANCE><SHORT-NAME>{label}</SHORT-NAME><CATEGORY>X</CATEGORY><SW-VALUE-CONT><UNIT-DISPLAY-NAME>{unit}</UNIT-DISPLAY-NAME>{size}"
        f"<SW-VALUES-PHYS>{values}</SW-VALUES-PHYS></SW-VALUE-CONT><SW-AXIS-CONTS>{axes}</SW-AXIS-CONTS></SW-INSTANCE>"
    )


def cells(*values: object) -> str:
    return "".join(f"<VT>{v}</VT>" if isinstance(v, str) else f"<V>{v}</V>" for v in values)


def axis(*values: object) -> str:
    return f"<SW-AXIS-CONT><SW-VALUES-PHYS>{cells(*values)}</SW-VALUES-PHYS></SW-AXIS-CONT>"


def rows(*lines: tuple) -> str:
    return "".join(f"<VG><LABEL>{label}</LABEL>{cells(*values)}</VG>" for label, *values in lines)


SOURCE_ONE = container("\n".join([
    instance("A_C", cells(33.3008)), instance("B_C", cells("on")), instance("Arr_CA", cells(0, 10), size="2"),
    instance("Crv_T", cells(10, 20, 40), axis(0, 1, 2)), instance("Map_M", rows((0, 1, 2), (10, 3, 4)), axis(0, 10) + axis(0, 10)), instance("Enum_M", rows(("a", "x", "y")), axis(1, 2)),
]))
SOURCE_TWO = container("\n".join([instance("A_C", cells(99)), instance("D_C", cells(5)), instance("D_C", cells(6)), instance("Lone_C", cells(1))]))
DESTINATION = container("\n".join([
    instance("A_C", cells(33.30078125)), instance("B_C", cells("off")), instance("Arr_CA", cells(7, 7, 7), size="3"),
    instance("Crv_T", cells(0, 0, 0, 0), axis(-1, 0.5, 1, 5)), instance("Map_M", rows((0, 0, 0), (5, 0, 0), (10, 0, 0)), axis(0, 5) + axis(0, 5, 10)),
    instance("Enum_M", rows(("a", "x", "z")), axis(1, 2)), instance("D_C", cells(5)), instance("E_C", cells(1)), instance("F_X", cells(1)),
]))
