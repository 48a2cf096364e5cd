"""Azure and GCP lists, database catalogs and SaaS lists, from their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

AZURE_GROUPS = "id string, name string, location string"
AZURE_VNETS = "id string, name string, location string, properties struct<addressSpace:struct<addressPrefixes:array<string>>,subnets:array<struct<id:string,name:string,properties:struct<addressPrefix:string>>>>"
AZURE_NSGS = "id string, name string, location string, properties struct<subnets:array<struct<id:string>>,securityRules:array<struct<name:string,properties:struct<access:string,direction:string,protocol:string,destinationPortRange:string,sourceAddressPrefix:string>>>>"
AZURE_VMS = "id string, name string, location string, properties struct<hardwareProfile:struct<vmSize:string>,networkProfile:struct<networkInterfaces:array<struct<properties:struct<ipConfigurations:array<struct<properties:struct<subnet:struct<id:string>>>>>>>>>"
GCP_NETWORKS = "selfLink string, name string, autoCreateSubnetworks boolean, routingConfig struct<routingMode:string>"
GCP_SUBNETS = "selfLink string, name string, network string, region string, ipCidrRange string"
GCP_FIREWALLS = "selfLink string, name string, network string, direction string, disabled boolean, allowed array<struct<IPProtocol:string,ports:array<string>>>, targetTags array<string>, sourceRanges array<string>, sourceTags array<string>"
GCP_INSTANCES = "selfLink string, name string, machineType string, zone string, tags struct<items:array<string>>, networkInterfaces array<struct<subnetwork:string>>"
DATABASES, SCHEMAS = "name string, owner string, encoding string", "database string, name string, owner string"
TABLES = "database string, schema string, name string, kind string, relkind string, estimated_rows bigint"
KEYS = "constraint_name string, database string, from_schema string, from_table string, from_columns array<string>, to_schema string, to_table string, to_columns array<string>"
APPS, ACCOUNTS = "id string, name string, vendor string, category string", "id string, name string, email string, kind string, app_id string"
RESOURCES, ACCESS = "id string, name string, kind string, app_id string, external_handle string", "id string, account_id string, resource_id string, scope string"


def resource_group(resource_id: Column) -> Column:
    """The resource group's name in an id, in any case."""
    return F.nullif(F.regexp_extract(resource_id, "(?i)/resourcegroups/([^/]+)", 1), F.lit(""))


def _or(name: str, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), fallback)


def azure(subscription: str, groups: DataFrame, vnets: DataFrame, nsgs: DataFrame, vms: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Items and edges of a subscription. A network group with inbound rules that allow is connected to each of its discovered subnets, with these
    rules as evidence; a machine runs on the subnet of its first network address, if that was discovered."""
    top, c, told = groups.sparkSession.range(1), F.col, F.lit
    e = lambda *args: common.edge(*args[:4], "azure", now, *args[4:])
    subnets = vnets.select(c("id").alias("vnet"), F.explode("properties.subnets").alias("s")).where("s.id <> ''")
    known = subnets.select(c("s.id").alias("subnet")).distinct()
    by_name = groups.groupBy(_or("name", c("id")).alias("_group")).agg(F.max("id").alias("_group_id"))
    group = resource_group(c("id"))
    within = lambda df: df.join(by_name, resource_group(c("id")) == c("_group"))
    rules = nsgs.select("id", F.explode("properties.subnets.id").alias("subnet"), c("properties.securityRules").alias("rules")).select("id", "subnet", F.explode("rules").alias("r"))
    inbound = rules.where("lower(r.properties.access) = 'allow' and lower(r.properties.direction) = 'inbound'").join(known, "subnet", "left_semi")
    label = F.concat(F.lit("azure:nsg:rule:"), _or("r.name", F.lit("<unnamed>")), F.lit(" allows "), _or("r.properties.protocol", F.lit("all")), F.lit("/"), _or("r.properties.destinationPortRange", F.lit("all")), F.lit(" from "), _or("r.properties.sourceAddressPrefix", F.lit("*")))
    addresses = F.flatten(F.transform("properties.networkProfile.networkInterfaces", lambda n: F.transform(F.coalesce(n["properties"]["ipConfigurations"], F.array()), lambda i: i["properties"]["subnet"]["id"])))
    first = F.try_element_at(F.filter(addresses, lambda x: x.isNotNull() & (x != "")), F.lit(1))
    runs = vms.withColumn("subnet", first).join(known, "subnet", "left_semi")
    items = common.union(
        common.item(top, "azure_subscription", F.lit(subscription), F.lit(subscription), subscription_id=F.lit(subscription)),
        common.item(groups, "azure_resource_group", c("id"), _or("name", c("id")), location=c("location")),
        common.item(vnets, "azure_vnet", c("id"), _or("name", c("id")), location=c("location"), address_space=c("properties.addressSpace.addressPrefixes"), resource_group=group),
        common.item(subnets, "azure_subnet", c("s.id"), _or("s.name", c("s.id")), address_prefix=c("s.properties.addressPrefix"), vnet=c("vnet")),
        common.item(nsgs, "azure_nsg", c("id"), _or("name", c("id")), location=c("location"), resource_group=group),
        common.item(vms, "azure_vm", c("id"), _or("name", c("id")), location=c("location"), vm_size=c("properties.hardwareProfile.vmSize"), resource_group=group),
    )
    edges = common.union(
        e(groups, "CONTAINS", ("azure_subscription", F.lit(subscription)), ("azure_resource_group", c("id")), told("azure:subscription:resource_group")),
        e(within(vnets), "CONTAINS", ("azure_resource_group", c("_group_id")), ("azure_vnet", c("id")), told("azure:resource_group:vnet")),
        e(within(vms), "CONTAINS", ("azure_resource_group", c("_group_id")), ("azure_vm", c("id")), told("azure:resource_group:vm")),
        e(subnets, "CONTAINS", ("azure_vnet", c("vnet")), ("azure_subnet", c("s.id")), told("azure:vnet:subnet")),
        e(inbound, "CONNECTS_TO", ("azure_nsg", c("id")), ("azure_subnet", c("subnet")), label),
        e(runs, "RUNS_ON", ("azure_vm", c("id")), ("azure_subnet", c("subnet")), told("azure:vm:nic:subnet")),
    )
    return items, edges


def gcp(project: str, networks: DataFrame, subnets: DataFrame, firewalls: DataFrame, instances: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Items and edges of a project. An instance runs on the first discovered subnetwork of its interfaces. An enabled ingress firewall that allows
    something leads to the subnetworks of its network (of all, if it names none) that hold an instance, with one of its target tags where it has some."""
    top, c, told = networks.sparkSession.range(1), F.col, F.lit
    e = lambda *args: common.edge(*args[:4], "gcp", now, *args[4:])
    owner = ("gcp_project", F.lit(project))
    nets = subnets.where("selfLink <> ''").select(c("selfLink").alias("subnet"), "network")
    placed = instances.select(c("selfLink").alias("instance"), c("tags.items").alias("tags"), F.posexplode("networkInterfaces.subnetwork").alias("nth", "subnet")).join(nets.select("subnet"), "subnet", "left_semi")
    runs = placed.groupBy("instance").agg(F.min_by("subnet", "nth").alias("subnet"))
    live = firewalls.where("upper(coalesce(nullif(direction, ''), 'INGRESS')) = 'INGRESS' and not coalesce(disabled, false) and size(allowed) > 0")
    ports = F.array_join(F.transform("allowed", lambda a: F.concat(F.coalesce(a["IPProtocol"], F.lit("all")), F.when(F.size(a["ports"]) > 0, F.concat(F.lit("/"), F.array_join(a["ports"], ","))).otherwise(""))), ",")
    from_ = F.when(F.size("sourceRanges") > 0, F.array_join(F.array_sort("sourceRanges"), ",")).when(F.size("sourceTags") > 0, F.concat(F.lit("tag:"), F.array_join(F.array_sort("sourceTags"), ","))).otherwise("*")
    label = F.concat(F.lit("gcp:firewall:rule:"), _or("name", F.lit("<unnamed>")), F.lit(" allows "), ports, F.lit(" from "), from_)
    live = live.select("selfLink", F.nullif("network", F.lit("")).alias("network"), F.coalesce("targetTags", F.array()).alias("targets"), label.alias("label"))
    # Meets by network and tag; the empty tag stands for any instance, and a firewall without a network meets each of them.
    offered = placed.join(nets, "subnet").select("subnet", "network", F.explode(F.array_union(F.coalesce("tags", F.array()), F.array(F.lit("")))).alias("tag")).distinct()
    asked = live.withColumn("tag", F.explode(F.when(F.size("targets") > 0, c("targets")).otherwise(F.array(F.lit("")))))
    reached = asked.where("network is not null").join(offered, ["network", "tag"]).select("selfLink", "subnet", "label").unionByName(asked.where("network is null").join(offered.select("subnet", "tag").distinct(), "tag").select("selfLink", "subnet", "label")).distinct()
    items = common.union(
        common.item(top, "gcp_project", F.lit(project), F.lit(project), project_id=F.lit(project)),
        common.item(networks, "gcp_network", c("selfLink"), _or("name", c("selfLink")), auto_create_subnetworks=c("autoCreateSubnetworks"), routing_mode=c("routingConfig.routingMode")),
        common.item(subnets, "gcp_subnetwork", c("selfLink"), _or("name", c("selfLink")), ip_cidr_range=c("ipCidrRange"), region=common.last_segment(c("region")), network=c("network")),
        common.item(firewalls, "gcp_firewall", c("selfLink"), _or("name", c("selfLink")), network=c("network"), direction=c("direction"), disabled=c("disabled")),
        common.item(instances, "gcp_instance", c("selfLink"), _or("name", c("selfLink")), machine_type=common.last_segment(c("machineType")), zone=common.last_segment(c("zone")), tags=F.coalesce("tags.items", F.array().cast("array<string>"))),
    )
    edges = common.union(
        e(networks, "CONTAINS", owner, ("gcp_network", c("selfLink")), told("gcp:project:network")),
        e(subnets.join(networks.select(c("selfLink").alias("network")), "network", "left_semi"), "CONTAINS", ("gcp_network", c("network")), ("gcp_subnetwork", c("selfLink")), told("gcp:network:subnetwork")),
        e(instances, "CONTAINS", owner, ("gcp_instance", c("selfLink")), told("gcp:project:instance")),
        e(runs, "RUNS_ON", ("gcp_instance", c("instance")), ("gcp_subnetwork", c("subnet")), told("gcp:instance:nic:subnetwork")),
        e(reached, "CONNECTS_TO", ("gcp_firewall", c("selfLink")), ("gcp_subnetwork", c("subnet")), c("label")),
    )
    return items, edges


def catalog(host: str, port: int, databases: DataFrame, schemas: DataFrame, tables: DataFrame, keys: DataFrame, now: Column, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items and edges of a database instance host:port; a foreign key between discovered tables is a DEPENDS_ON edge with its constraint's
    name as edge_key."""
    top, c, told, instance = databases.sparkSession.range(1), F.col, F.lit, f"{host}:{port}"
    e = lambda *args: common.edge(*args[:4], "db", now, *args[4:])
    path = lambda *parts: F.concat_ws("/", F.lit(instance), *parts)
    held = tables.where("name <> ''").select("database", "schema", "name").distinct()
    side = lambda end: held.select("database", c("schema").alias(f"{end}_schema"), c("name").alias(f"{end}_table"))
    keys = keys.join(side("from"), ["database", "from_schema", "from_table"], "left_semi").join(side("to"), ["database", "to_schema", "to_table"], "left_semi")
    constraint = _or("constraint_name", F.lit("<unnamed>"))
    columns = lambda end: F.concat(f"{end}_schema", F.lit("."), f"{end}_table", F.lit("("), F.array_join(F.coalesce(f"{end}_columns", F.array()), ","), F.lit(")"))
    detail = F.concat(F.lit("db:fk:"), constraint, F.lit(" ("), columns("from"), F.lit(" -> "), columns("to"), F.lit(")"))
    items = common.union(
        common.item(top, "db_instance", F.lit(instance), F.lit(name or instance), host=F.lit(host), port=F.lit(port), engine=F.lit("postgresql")),
        common.item(databases, "db_database", path("name"), c("name"), database=c("name"), owner=c("owner"), encoding=c("encoding")),
        common.item(schemas, "db_schema", path("database", "name"), c("name"), database=c("database"), schema=c("name"), owner=c("owner")),
        common.item(tables, "db_table", path("database", "schema", "name"), c("name"), database=c("database"), schema=c("schema"), table=c("name"), kind=F.coalesce(F.nullif("kind", F.lit("")), "relkind"), estimated_rows=c("estimated_rows")),
    )
    edges = common.union(
        e(databases, "CONTAINS", ("db_instance", F.lit(instance)), ("db_database", path("name")), told("db:instance:database")),
        e(schemas.join(databases.select(c("name").alias("database")), "database", "left_semi"), "CONTAINS", ("db_database", path("database")), ("db_schema", path("database", "name")), told("db:database:schema")),
        e(tables.join(schemas.select("database", c("name").alias("schema")), ["database", "schema"], "left_semi"), "CONTAINS", ("db_schema", path("database", "schema")), ("db_table", path("database", "schema", "name")), told("db:schema:table")),
        e(keys, "DEPENDS_ON", ("db_table", path("database", "from_schema", "from_table")), ("db_table", path("database", "to_schema", "to_table")), detail, constraint),
    )
    return items, edges


def saas(account: str, apps: DataFrame, accounts: DataFrame, resources: DataFrame, grants: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Items and edges of a SaaS account: external ids begin with it. A resource with an external handle depends on the resource of that external id; a grant finds
    its resource by id alone, the one of the last app winning."""
    c, told = F.col, F.lit
    e = lambda *args: common.edge(*args[:4], "saas", now, *args[4:])
    key = lambda *parts: F.concat_ws("/", F.lit(account), *parts)
    known = apps.where("id <> ''").select(c("id").alias("app_id")).distinct()
    of_resource = resources.where("id <> ''").groupBy(c("id").alias("resource_id")).agg(F.max("app_id").alias("_app"))
    allowed = grants.join(of_resource, "resource_id").join(accounts.select(c("id").alias("account_id")).distinct(), "account_id", "left_semi")
    grant = F.coalesce(F.nullif("id", F.lit("")), F.nullif("scope", F.lit("")))
    handed = resources.where("external_handle <> ''")
    items = common.union(
        common.item(apps, "saas_app", key("id"), _or("name", c("id")), app_id=c("id"), vendor=c("vendor"), category=c("category")),
        common.item(accounts, "saas_account", key("id"), _or("name", c("id")), account_id=c("id"), email=c("email"), kind=c("kind")),
        common.item(resources, "saas_resource", key("app_id", "id"), _or("name", c("id")), app_id=c("app_id"), resource_id=c("id"), kind=c("kind"), external_handle=c("external_handle")),
    )
    edges = common.union(
        e(accounts.join(known, "app_id", "left_semi"), "CONTAINS", ("saas_app", key("app_id")), ("saas_account", key("id")), told("saas:app:account")),
        e(resources.join(known, "app_id", "left_semi"), "CONTAINS", ("saas_app", key("app_id")), ("saas_resource", key("app_id", "id")), told("saas:app:resource")),
        e(handed, "DEPENDS_ON", ("saas_resource", key("app_id", "id")), ("saas_resource", c("external_handle")), F.concat(F.lit("saas:resource:depends_on:"), "external_handle"), c("external_handle")),
        e(allowed, "HAS_ACCESS_TO", ("saas_account", key("account_id")), ("saas_resource", key("_app", "resource_id")), F.concat(F.lit("saas:grant:"), F.coalesce(grant, F.lit("<unnamed>")), F.lit(" (scope="), F.coalesce("scope", F.lit("None")), F.lit(")")), F.coalesce(grant, F.lit(""))),
    )
    return items, edges
