"""Phrases that stand before personal data and before what only looks so, in English, German, French and Spanish."""

_THINGS = [
    "order", "invoice no", "part number", "serial", "ticket #", "item", "version", "model", "the sum of", "between", "isbn", "ref",
    "bestellung", "rechnung nr.", "artikelnummer", "seriennummer", "vorgang", "modell", "zwischen", "teil", "az.",
    "commande", "facture n°", "référence", "pièce", "numéro de série", "modèle", "entre", "dossier", "lot",
    "pedido", "factura n.º", "referencia", "pieza", "número de serie", "modelo", "expediente", "lote",
]

AGAINST = {
    "phone-local": _THINGS,
    "email-spelt": ["look", "he stood", "time", "version", "item", "schau", "er stand", "uhrzeit", "regarde", "il était", "heure", "mira", "estaba", "hora"],
    "national-id": _THINGS,
    "iban": ["key", "token", "build", "licence", "schlüssel", "lizenz", "clé", "jeton", "clave", "licencia", *_THINGS],
    "ipv6": ["mac", "time", "hash", "key", "at the time", "digest", "uhrzeit", "prüfsumme", "schlüssel", "heure", "empreinte", "clé", "hora", "huella", "clave"],
}

FOR = {
    "phone-local": [
        "call me at", "phone", "tel", "my mobile is", "fax", "cell", "telephone number", "call her on", "reach him on", "text me on", "my number is", "phone him on", "call", "please call", "phone number", "ring", "dial",
        "ruf mich an unter", "telefon", "meine handynummer ist", "mobil", "telefonnummer", "anrufen unter", "erreichbar unter", "sie hat die nummer",
        "appelez-moi au", "téléphone", "mon portable est le", "tél", "joindre au", "appeler le", "mon numéro est le",
        "llámame al", "teléfono", "mi móvil es", "llamar al", "mi número es el", "llame al", "contacto telefónico",
    ],
    "email-spelt": ["mail me at", "contact", "e-mail", "write to", "reach me at", "schreib an", "kontakt", "mailadresse", "écrivez à", "contactez", "courriel", "escribe a", "contacto", "correo"],
    "national-id": [
        "ssn", "social security number", "her tax id is", "national id", "taxpayer number", "his social is", "social", "identity number", "social security no",
        "steuernummer", "sozialversicherungsnummer", "personalausweis", "steuer-id", "sozialversicherung", "ausweisnummer",
        "numéro de sécurité sociale", "carte d'identité", "numéro fiscal", "sécurité sociale", "identifiant fiscal", "assuré social",
        "número de la seguridad social", "documento de identidad", "identificación fiscal", "seguridad social", "número fiscal", "identidad",
    ],
    "iban": ["iban", "bank account", "transfer to", "pay to", "account number", "konto", "bankverbindung", "überweisen auf", "compte bancaire", "virement sur", "compte", "cuenta bancaria", "transferir a", "cuenta"],
    "ipv6": ["ip", "host", "server at", "ping", "address", "from", "ip address", "ipv6", "client", "peer", "gateway", "connected from", "server", "adresse", "rechner", "von", "adresse ip", "serveur", "depuis", "dirección", "servidor", "desde"],
}
