"""Markets: number formats, magnitude words, hosts and availability phrases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Market:
    code: str
    host: str
    currency: str
    decimal: str
    thousands: str
    symbols: tuple[str, ...]
    magnitudes: tuple[tuple[str, int], ...]
    #: (state, phrases) in the order of testing: negative phrases first, since some hold the positive ones
    availability: tuple[tuple[str, tuple[str, ...]], ...]
    rank_join: str = "in"


#: Formats, currencies, symbols, magnitude words, phrases and hosts of the seven markets.
MARKETS = {
    "US": Market("US", "www.amazon.com", "USD", ".", ",", ("$", "USD", "US$"), (("K", 1000), ("M", 1000000)), (
        ("OUT_OF_STOCK", ("currently unavailable", "out of stock", "temporarily out of stock")),
        ("LIMITED_STOCK", ("only", "left in stock")),
        ("PREORDER", ("pre-order", "available for pre-order")),
        ("BACKORDER", ("usually ships within", "on backorder")),
        ("IN_STOCK", ("in stock", "available now")),
    )),
    "UK": Market("UK", "www.amazon.co.uk", "GBP", ".", ",", ("£", "GBP"), (("K", 1000), ("M", 1000000)), (
        ("OUT_OF_STOCK", ("currently unavailable", "out of stock")),
        ("LIMITED_STOCK", ("only", "left in stock")),
        ("PREORDER", ("pre-order",)),
        ("BACKORDER", ("usually dispatched within", "on backorder")),
        ("IN_STOCK", ("in stock",)),
    )),
    "CA": Market("CA", "www.amazon.ca", "CAD", ".", ",", ("$", "CAD", "CDN$", "CA$"), (("K", 1000), ("M", 1000000)), (
        ("OUT_OF_STOCK", ("currently unavailable", "out of stock", "actuellement indisponible")),
        ("LIMITED_STOCK", ("only", "left in stock", "plus que")),
        ("PREORDER", ("pre-order", "précommande")),
        ("BACKORDER", ("usually ships within", "on backorder")),
        ("IN_STOCK", ("in stock", "en stock")),
    )),
    "DE": Market("DE", "www.amazon.de", "EUR", ",", ".", ("€", "EUR"), (("Tsd", 1000), ("Mio", 1000000), ("K", 1000)), (
        ("OUT_OF_STOCK", ("derzeit nicht verfügbar", "nicht auf lager", "nicht verfügbar")),
        ("LIMITED_STOCK", ("nur noch",)),
        ("PREORDER", ("vorbestellen", "vorbestellung")),
        ("BACKORDER", ("gewöhnlich versandfertig in",)),
        ("IN_STOCK", ("auf lager", "verfügbar")),
    )),
    "FR": Market("FR", "www.amazon.fr", "EUR", ",", " ", ("€", "EUR"), (("k", 1000), ("M", 1000000)), (
        ("OUT_OF_STOCK", ("actuellement indisponible", "rupture de stock", "indisponible")),
        ("LIMITED_STOCK", ("il ne reste plus que", "plus que")),
        ("PREORDER", ("précommandez", "précommande")),
        ("BACKORDER", ("habituellement expédié sous",)),
        ("IN_STOCK", ("en stock", "disponible")),
    ), rank_join="en"),
    "IT": Market("IT", "www.amazon.it", "EUR", ",", ".", ("€", "EUR"), (("mila", 1000), ("K", 1000), ("Mln", 1000000)), (
        ("OUT_OF_STOCK", ("attualmente non disponibile", "esaurito", "non disponibile")),
        ("LIMITED_STOCK", ("disponibilità: solo", "solo")),
        ("PREORDER", ("pre-ordina", "preordine")),
        ("BACKORDER", ("generalmente spedito entro",)),
        ("IN_STOCK", ("disponibilità immediata", "disponibile", "in stock")),
    )),
    "ES": Market("ES", "www.amazon.es", "EUR", ",", ".", ("€", "EUR"), (("mil", 1000), ("K", 1000), ("M", 1000000)), (
        ("OUT_OF_STOCK", ("no disponible por el momento", "agotado", "no disponible")),
        ("LIMITED_STOCK", ("solo queda", "quedan solo")),
        ("PREORDER", ("resérvalo ya", "precompra")),
        ("BACKORDER", ("normalmente se envía en",)),
        ("IN_STOCK", ("en stock", "disponible")),
    ), rank_join="en"),
}


#: What stands before a seller's and a shipper's name, what marks a rank and a number of recent buyers, by market.
LABELS = {
    "US": {"sold_by": ("Sold by", "Ships from and sold by"), "ships_from": ("Ships from", "Dispatches from"), "rank": ("Best Sellers Rank", "Amazon Best Sellers Rank"), "bought": ("bought in past month",)},
    "UK": {"sold_by": ("Sold by", "Dispatches from and sold by"), "ships_from": ("Dispatches from", "Ships from"), "rank": ("Best Sellers Rank", "Amazon Bestsellers Rank"), "bought": ("bought in past month",)},
    "CA": {"sold_by": ("Sold by", "Ships from and sold by", "Vendu par"), "ships_from": ("Ships from", "Dispatches from", "Expédié par"),
           "rank": ("Best Sellers Rank", "Amazon Best Sellers Rank", "Classement des meilleures ventes"), "bought": ("bought in past month", "achetés au cours du mois dernier")},
    "DE": {"sold_by": ("Verkauf durch", "Verkauf und Versand durch"), "ships_from": ("Versand durch",), "rank": ("Amazon Bestseller-Rang", "Bestseller-Rang", "Amazon Bestseller Rang"),
           "bought": ("mal im letzten monat gekauft", "im letzten monat gekauft")},
    "FR": {"sold_by": ("Vendu par", "Expédié et vendu par"), "ships_from": ("Expédié par",), "rank": ("Classement des meilleures ventes d’Amazon", "Classement des meilleures ventes d'Amazon", "Classement parmi les meilleures ventes"),
           "bought": ("achetés au cours du mois dernier", "acheté au cours du mois dernier")},
    "IT": {"sold_by": ("Venduto da", "Spedito e venduto da"), "ships_from": ("Spedizione da", "Spedito da"), "rank": ("Posizione nella classifica Bestseller di Amazon", "Classifica Bestseller di Amazon"),
           "bought": ("acquistati nel mese scorso", "acquistato nel mese scorso")},
    "ES": {"sold_by": ("Vendido por", "Envíos y vendido por", "Enviado y vendido por"), "ships_from": ("Envíos desde", "Enviado desde"),
           "rank": ("Clasificación en los más vendidos de Amazon", "Clasificación de los más vendidos en Amazon"), "bought": ("comprados el mes pasado", "comprado el mes pasado")},
}


def market_table(spark: SparkSession) -> DataFrame:
    """The market dimension: code, host, currency, decimal, thousands. Seven rows."""
    return spark.createDataFrame([(m.code, m.host, m.currency, m.decimal, m.thousands) for m in MARKETS.values()], "code string, host string, currency string, decimal string, thousands string")
