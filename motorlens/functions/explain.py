"""Sentences that say how a route's profit or a regime's tax comes about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.domain import VAT

# The sentences' wording. %s stands for the parts in their order.
ROUTE_PRICE = "Market price in %s: €%s"
ROUTE_VAT = "VAT/customs cost: −€%s"
ROUTE_NO_VAT = "Intra-EU reverse charge: €0 VAT"
ROUTE_TRANSPORT = "Transport cost: −€%s"
ROUTE_PROFIT = "Net profit: €%s via %s"
MARGIN = "Régimen de margen (Art. 313 Dir. IVA): IVA %s%% sobre margen €%s. IVA incorporado €%s no deducible por el comprador. Precio total facturado: €%s"
REVERSE_CHARGE = "Adquisición intracomunitaria 0%% (Art. 20 Dir. IVA): factura sin IVA. Comprador aplica reverse-charge %s%% en %s y deduce íntegramente. Coste IVA neto: €0,00. Precio neto: €%s"
NEW_VEHICLE = "Vehículo nuevo Art. 2(2)(b): IVA %s%% OBLIGATORIO en destino %s. IVA sobre precio íntegro €%s = €%s. Total bruto: €%s. Sujeto pasivo en %s: IVA recuperable como input tax."
TO_SWITZERLAND = "Exportación UE→CH (Art. 146 Dir. IVA): 0%% IVA en origen %s. Importación suiza MWST %s%% sobre valor CIF €%s = €%s. Total bruto: €%s. Comprador CH inscrito MWST: IVA importación recuperable."
FROM_SWITZERLAND = "Exportación CH→UE (Art. 23 MWSTG): 0%% MWST en origen. IVA importación %s %s%% sobre valor declarado €%s = €%s. Total bruto: €%s. Comprador EU-VAT inscrito en %s: IVA importación recuperable como input tax."


def whole_euros(cents: Column) -> Column:
    """Cents as whole euros, halves to the even one; a small loss is '-0'."""
    euros = F.bround(cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)"), 0).cast("decimal(20,0)")
    return F.when((cents < 0) & (euros == 0), F.lit("-0")).otherwise(euros.cast("string"))


def euros(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").cast("string")


def percent(country: Column, places: int = 0) -> Column:
    return F.coalesce(*(F.when(country == k, F.lit(f"{100 * v:.{places}f}")) for k, v in VAT.items()))


def route(country: Column, channel: Column, price: Column, vat: Column, transport: Column, net: Column) -> Column:
    """Price, taxes, transport (where it costs anything) and profit of a route, all in cents."""
    return F.concat_ws(
        " | ", F.format_string(ROUTE_PRICE, country, whole_euros(price)), F.when(vat > 0, F.format_string(ROUTE_VAT, whole_euros(vat))).otherwise(ROUTE_NO_VAT),
        F.when(transport > 0, F.format_string(ROUTE_TRANSPORT, whole_euros(transport))), F.format_string(ROUTE_PROFIT, whole_euros(net), channel),
    )


def tax(regime: Column, origin: Column, dest: Column, new: Column, price: Column, margin: Column, vat: Column, total: Column) -> Column:
    """What a VAT regime means for a sale; null for a regime of another name. Amounts in cents."""
    import_tax = F.when(dest == "CH", F.format_string(TO_SWITZERLAND, origin, percent(dest, 1), euros(price), euros(vat), euros(total)))
    return (
        F.when(regime == "MARGIN_SCHEME", F.format_string(MARGIN, percent(origin), euros(margin), euros(vat), euros(price)))
        .when((regime == "INTRA_COMMUNITY") & ~new, F.format_string(REVERSE_CHARGE, percent(dest), dest, euros(price)))
        .when(regime == "INTRA_COMMUNITY", F.format_string(NEW_VEHICLE, percent(dest), dest, euros(price), euros(vat), euros(total), dest))
        .when(regime == "EXPORT_IMPORT", import_tax.otherwise(F.format_string(FROM_SWITZERLAND, dest, percent(dest), euros(price), euros(vat), euros(total), dest)))
    )
