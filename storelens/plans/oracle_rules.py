"""Rule tables of the catalog oracles: copies of their own, so that a changed rule of the operators shows as a mismatch."""

from __future__ import annotations

# --- Fixed values: vocabularies, role rules and readiness groups that results must agree with. ---
# (field, tokens, table tokens, weak tokens, column groups, required, label)
CANONICAL_FIELDS = [
    ("product.identity",
     ["productid", "productcode", "itemcode", "sku", "pcode", "prodid"],
     ["product", "item", "sku", "catalog"], [], [], True, "Product/SKU identity"),
    ("purchase.quantity",
     ["quantity", "qty", "pieces", "pcs", "purchaseqty", "receivedqty"],
     ["purchase", "receipt", "receiving", "inward", "goodsreceived"], [], [], True, "Purchase/receiving quantity"),
    ("product.pack_size",
     ["packsize", "unitspercase", "pcspercarton", "conversion", "packing", "factor"],
     ["product", "item", "stock", "purchase", "catalog"], [],
     [["carton", "cartoon", "case", "box"], ["pcs", "piece", "unit"]], True, "Carton/pack/piece conversion"),
    ("movement.destination",
     ["destination", "destinationid", "dest", "godown", "warehouse", "location", "locationid"],
     ["movement", "transfer", "stock", "godown", "warehouse", "shelf", "receipt"],
     ["location", "locationid"], [], True, "Godown/shelf destination"),
    ("camera.zone",
     ["camerazone", "cameraname", "cameraid", "channel", "camchannel", "zone", "zonename", "area", "role", "streamid"],
     ["camera", "cctv", "channel", "stream", "zone"],
     ["channel", "cameraid", "streamid"], [], True, "Camera channel and monitored zone"),
    ("staff.role",
     ["staffrole", "role", "designation", "duty", "jobtitle"],
     ["staff", "employee", "worker", "user", "role", "emp"], [], [], True, "DEO/staff task routing"),
    ("sale.quantity",
     ["saleqty", "soldqty", "unitsold", "billqty"],
     ["sale", "bill", "invoice", "pos"], [], [], False, "POS sale quantity"),
    ("damage.quantity",
     ["damageqty", "damagedunits", "wastage", "brokenqty"],
     ["damage", "stock", "item", "product"], [], [], False, "Damage quantity"),
    ("attendance.identity",
     ["badgeid", "staffid", "employeeid", "attendanceid"],
     ["attendance", "staff", "employee", "worker", "emp"], [], [], False, "Attendance identity"),
]
# (role, table tokens, column-signature groups, positive, negative)
ROLE_RULES = [
    ("product_catalog", ["product", "item", "sku", "catalog"],
     [["itemid", "productid", "itemcode", "productcode", "sku"], ["itemname", "productname", "description", "name"]],
     ["master", "mas", "mst", "catalog"], []),
    ("sale_header", ["sale", "invoice", "bill", "checkout", "pos"],
     [["saledate", "invoicedate", "billdate", "date"], ["netamt", "total", "grossamt", "amount"]],
     ["header", "hdr"], ["detail", "dtl", "line"]),
    ("sale_line", ["sale", "invoice", "bill", "checkout", "pos"],
     [["qty", "quantity", "soldqty"], ["itemid", "productid", "itemcode", "sku"]],
     ["detail", "dtl", "line"], []),
    ("purchase_header", ["purchase", "receipt", "receiving", "inward", "goodsreceived"],
     [["purchasedate", "receiptdate", "receiveddate", "date"], ["netamt", "total", "grossamt", "amount"]],
     ["header", "hdr"], ["detail", "dtl", "line"]),
    ("purchase_line", ["purchase", "receipt", "receiving", "inward", "goodsreceived"],
     [["qty", "quantity", "receivedqty"], ["itemid", "productid", "itemcode", "sku"]],
     ["detail", "dtl", "line"], []),
    ("inventory_stock", ["stock", "inventory", "onhand"],
     [["qty", "quantity", "onhand", "balance"], ["itemid", "productid", "itemcode", "sku"]],
     ["stock", "inventory"], []),
    ("stock_movement", ["movement", "transfer", "issue", "dispatch", "godown", "warehouse", "shelf"],
     [["qty", "quantity", "units"], ["destination", "source", "location", "godown", "warehouse", "shelf"]],
     ["movement", "transfer", "issue", "dispatch"], []),
    ("damage_expiry", ["damage", "expiry", "expired", "waste", "stock", "inventory"],
     [["damageqty", "expiryqty", "wastage", "brokenqty", "expdate"]],
     ["damage", "expiry", "waste"], []),
    ("staff_directory", ["staff", "employee", "worker", "user", "emp"],
     [["staffid", "employeeid", "userid", "empid", "uid"], ["role", "designation", "duty", "jobtitle"]],
     ["staff", "employee", "worker", "emp"], []),
    ("attendance", ["attendance", "shift", "punch", "timesheet"],
     [["staffid", "employeeid", "userid", "empid", "uid"], ["inat", "outat", "checkin", "checkout", "status", "shift"]],
     ["attendance", "punch", "timesheet"], []),
    ("camera_registry", ["camera", "cctv", "channel", "stream"],
     [["channel", "cameraid", "streamid"], ["role", "zone", "location", "name"]],
     ["camera", "cctv", "channel"], []),
    ("camera_events", ["camera", "event", "observation", "detection"],
     [["eventid", "observationid", "detectionid"], ["startedat", "endedat", "occurredat", "timestamp"],
      ["channel", "cameraid", "streamid"]],
     ["event", "observation", "detection"], []),
]
# Readiness groups: (key, label, fields)
READINESS_GROUPS = [
    ("purchase_mapping", "Purchase and product mapping", ["product.identity", "purchase.quantity"]),
    ("pack_conversion", "Carton/pack/piece conversion", ["product.pack_size"]),
    ("locations", "Godown and shelf destinations", ["movement.destination"]),
    ("camera", "Camera source and zone purpose", ["camera.zone"]),
    ("routing", "DEO and staff role routing", ["staff.role"]),
]
# ---------------------------------------------------------------------------
