"""Words and patterns by which receipt fields are known."""

from __future__ import annotations

# Fixed values, in the order in which they are tried.
TOTAL_FIRST = ("TOTAL FINAL", "A PAGAR")
TOTAL_LABELS = ("TOTAL", "MONTO BOLETA")
TOTAL_EXCLUDED = ("TOTAL AFECTO", "TOTAL EXENTO", "TOTAL IVA")
OTHER_LABELS = ("NETO", "EXENTO", "IVA", "SUBTOTAL", "DESCUENTO", "AFECTO")
TABLE_HEADER = ("CANT", "CÓD", "COD", "PROD", "DESCRIPCION", "DESCRIPCIÓN", "P.UNIT", "PUNIT", "PRECIO", "VALOR")
NOT_PRODUCT = (
    "TOTAL", "SUBTOTAL", "NETO", "IVA", "VUELTO", "CAMBIO", "PROPINA", "FECHA", "HORA", "RUT", "BOLETA", "FOLIO", "FACTURA",
    "MEDIO DE PAGO", "FORMA DE PAGO", "PAGO", "GRACIAS", "CAJERO", "VENDEDOR", "SUCURSAL", "DIRECCION", "TELEFONO", "CLIENTE",
    "ATENDIDO", "MESA", "GARZON", "CLP", "PESOS", "PESO", "DEBITO", "DÉBITO", "CREDITO", "CRÉDITO", "EFECTIVO", "DEBIT",
    "CREDIT", "PUNTOS", "ACUMULADO",
)
PAYMENT_METHODS = (
    ("EFECTIVO", "Efectivo"), ("DEBITO", "Débito"), ("DÉBITO", "Débito"), ("CREDITO", "Crédito"), ("CRÉDITO", "Crédito"),
    ("REDCOMPRA", "Débito"), ("TRANSFERENCIA", "Transferencia"), ("TRANSBANK", "Débito/Crédito"), ("CHEQUE", "Cheque"),
    ("VISA", "Tarjeta"), ("MASTERCARD", "Tarjeta"), ("DEBIT", "Débito"), ("CREDIT", "Crédito"),
)
COMPANY_SUFFIXES = ("SA", "LTDA", "LIMITADA", "SPA", "EIRL")
DATE = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
RESOLUTION_WORD, RESOLUTION_DATE = "RESOLUC", "2014-08-22"
FOLIO = r"(?iU)(?:FOLIO|BOLETA(?:\s+ELECTRONICA)?|N[°ºo]?)\s*[:\-]?\s*(\d{4,})"
RUT_LABEL = r"(?U)R[.,]?\s?U[.,]?\s?T[.,]?\b"
ONLY_NUMBERS = r"(?U)^[\d\s.,\-/:]+$"
ONLY_SEPARATORS = r"(?U)^[\s\-=_*.]+$"
LETTER = "[A-Za-zÁÉÍÓÚÑáéíóúñ]"
EDGES = " .-:$"
