"""Sentences to measure the personal-information model on. None of their frames is among the training frames."""

FRAMES = """
Skipper {N} brought the lifeboat home {time}.
Our thanks go to {N} and to the neighbours of {place}.
Choreography {N}, lighting {N}
When {N} retired, the workshop closed.
"It rained all week", recalls {N}.
Third place went to {N} ({place}).
Witness: {N}
The will of {N} mentions {thing}.
Beekeeper {N}, {A}, sells honey {time}.
{N} / {E}
{N}; {P}
Conductor {N} bowed twice.
La patrona {N} llevó el barco a puerto.
Gracias a {N} y a los vecinos de {place}.
Testigo: {N}
Cuando se jubiló {N}, cerró el taller.
El testamento de {N} menciona {cosa}.
Kapitän {N} brachte das Boot heim.
Unser Dank gilt {N} und den Nachbarn.
Zeuge: {N}
Als {N} in Rente ging, schloss die Werkstatt.
Entries to {E} please, by {date}.
Spam caught from {E} {time}
Bitte melden unter {E}
Apúntese en {E} hoy mismo
The harbour master picks up on {P} {time}.
WhatsApp {P}
Taxi rank {P}
Anrufbeantworter: {P}
Contestador: {P}
A thief used {idcue} {I} {time}.
Lost property: {idcue} {I}
Gefunden: {idcue} {I}
Extraviado: {idcue} {I}
We have rented {A} since {year}.
A pipe burst outside {A} {time}.
Se alquila local en {A}
Rohrbruch vor dem Haus {A}
Swim in the {surname} {building} {time}.
The {surname} {honour} honours {thing}.
Beside {surname} {building} stands a kiosk.
Concierto en el Teatro {surname}
Konzert im {surname}-Saal
{cap} for beginners
All about {cap}
{cap}, {cap}, {cap}
Todo sobre {capes}
Alles über {capde}
Parcel {ref} is late.
Part {ref} fits model {ref}.
Claim {ref} closed {date}
Sala {room}: {cosa}
Raum {room}: {ding}
Unit {code} needs no textbook.
Founded {year}, rebuilt {year}, {small} seats
Paket {ref} kommt später.
""".strip().split("\n")
