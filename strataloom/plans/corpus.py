"""A source tree derived from a table: for each supplier one small project in every ecosystem.

The texts are ours. `@K@` stands for the supplier's key, so names, topics and paths differ from project to project and
the tree grows with the table. With each text goes what a scanner has to find in it, row by row; an expected value
`sha:a|b` is the id made of these parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sample:
    """files: (path, text); finds: table -> (columns, rows); when: (m, r): only for suppliers whose key modulo m is r.

    also: what other scanners find in these files.
    """

    scanner: str
    files: list[tuple[str, str]]
    finds: dict[str, tuple[str, list[tuple]]]
    when: tuple[int, int] = (1, 0)
    also: tuple[tuple[str, str, str, tuple], ...] = ()


P = "s@K@"
API = "component_id path method"
CALL = API + " request_schema response_schema"
FLOW = "publisher_component_id subscriber_component_id topic"
DEP = "source_component_id group_id artifact_id version scope"
ENT = "component_id name primary_key fields"
REL = "source_id target_id type"
COMP = "id name type"

SAMPLES = [
    Sample("maven-dependencies", [(f"{P}/maven/pom.xml", """<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>org.s@K@</groupId><artifactId>root</artifactId><version>1.@K@</version></parent>
<artifactId>shop@K@</artifactId><properties><jackson.version>2.17</jackson.version></properties>
<dependencies><dependency><groupId>com.fasterxml</groupId><artifactId>jackson</artifactId><version>${jackson.version}</version></dependency>
<dependency><groupId>${project.groupId}</groupId><artifactId>common</artifactId><version>${project.version}</version><scope>test</scope></dependency>
<dependency><groupId>org.springframework</groupId><artifactId>spring-web</artifactId><version>${nowhere}</version></dependency></dependencies></project>""")],
        {"components": (COMP, [("sha:maven|org.s@K@|shop@K@", "shop@K@", "LIBRARY")]),
         "dependencies": (DEP, [("shop@K@", "com.fasterxml", "jackson", "2.17", "compile"), ("shop@K@", "org.s@K@", "common", "1.@K@", "test"), ("shop@K@", "org.springframework", "spring-web", "${nowhere}", "compile")])}),
    Sample("gradle-dependencies", [("gradle/app@K@/build.gradle", "dependencies {\n  implementation 'com.google:guava:@K@.1'\n  testImplementation(\"org.junit:junit:5\")\n  compileOnly group: 'org.x', name: 'y', version: '3'\n}")],
        {"components": (COMP, [("sha:gradle|app@K@", "app@K@", "SERVICE")]),
         "dependencies": (DEP, [("app@K@", "com.google", "guava", "@K@.1", "compile"), ("app@K@", "org.junit", "junit", "5", "test"), ("app@K@", "org.x", "y", "3", "provided")])}),
    Sample("npm-dependencies", [(f"{P}/web/package.json", '{"name": "web@K@", "dependencies": {"express": "^4", "@nestjs/core": "10"}, "devDependencies": {"jest": "29.@K@"}}')],
        {"components": (COMP, [("sha:npm|web@K@", "web@K@", "SERVICE")]),
         "dependencies": (DEP, [("web@K@", "npm", "express", "^4", "compile"), ("web@K@", "@nestjs", "core", "10", "compile"), ("web@K@", "npm", "jest", "29.@K@", "test")])}),
    Sample("pip-poetry-dependencies", [("py/pip@K@/requirements.txt", "# pinned\nflask==2.@K@\n-r base.txt\nnumpy\nrequests[security]>=2.31  # net\n"), ("py/poet@K@/pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.12"\ndjango = "^5.@K@"\n[tool.poetry.group.dev.dependencies]\npytest = "8"\n')],
        {"components": (COMP, [("sha:python|pip@K@", "pip@K@", "SERVICE"), ("sha:python|poet@K@", "poet@K@", "SERVICE")]),
         "dependencies": (DEP, [("sha:python|pip@K@", "pypi", "flask", "2.@K@", "compile"), ("sha:python|pip@K@", "pypi", "requests", "2.31", "compile"), ("sha:python|poet@K@", "pypi", "django", "5.@K@", "compile"), ("sha:python|poet@K@", "pypi", "pytest", "8", "test")])}),
    Sample("nuget-dependencies", [(f"{P}/net/Shop@K@.csproj", '<Project><ItemGroup><PackageReference Include="Dapper" Version="2.@K@" /><PackageReference Include="Serilog" /><Reference Include="System.Xml" /><Reference Include="Old.Lib, Version=4.5.6.0" /></ItemGroup></Project>')],
        {"components": (COMP, [("sha:nuget|Shop@K@", "Shop@K@", "SERVICE")]),
         "dependencies": (DEP, [("sha:nuget|Shop@K@", "nuget", "Dapper", "2.@K@", "compile"), ("sha:nuget|Shop@K@", "nuget", "Serilog", "*", "compile"), ("sha:nuget|Shop@K@", "nuget", "Old.Lib", "4.5.6", "compile")])}),
    Sample("dotnet-solution", [(f"{P}/net/all.sln", 'Project("{FAE0}") = "Web@K@", "src\\Web\\Web.csproj", "{1}"\nProject("{FAE0}") = "Web@K@", "again\\Web.csproj", "{1}"\nProject("{FAE0}") = "Tests@K@", "test\\T.csproj", "{2}"\nProject("{FAE0}") = "Util@K@", "src\\Util.csproj", "{3}"\nProject("{2150}") = "folder", "folder", "{4}"\n')],
        {"components": (COMP, [("sha:dotnet-project|Web@K@", "Web@K@", "SERVICE"), ("sha:dotnet-project|Tests@K@", "Tests@K@", "MODULE"), ("sha:dotnet-project|Util@K@", "Util@K@", "LIBRARY")])}),
    Sample("go-modules", [(f"{P}/go/go.mod", "module example.org/shop@K@\n\ngo 1.22\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.@K@\n\tgithub.com/jackc/pgx/v5 v5.5.0 // indirect\n)\n\nrequire golang.org/x/text v0.14.0\n")],
        {"components": (COMP, [("sha:go|example.org/shop@K@", "example.org/shop@K@", "SERVICE")]),
         "dependencies": (DEP + " direct", [("example.org/shop@K@", "github.com/gin-gonic", "gin", "v1.9.@K@", "compile", True), ("example.org/shop@K@", "github.com/jackc", "pgx/v5", "v5.5.0", "compile", False), ("example.org/shop@K@", "golang.org/x", "text", "v0.14.0", "compile", True)])}),
    Sample("bundler-dependencies", [("rb/gems@K@/Gemfile", "gem 'rails', '~> 7.@K@'\ngem 'puma'\ngroup :test do\n  gem 'rspec', '3.0'\nend\ngem 'pg'\n"), ("rb/gems@K@/Gemfile.lock", "GEM\n  specs:\n    puma (6.@K@)\n      nio4r (~> 2.0)\n    rspec (3.12)\n")],
        {"components": (COMP, [("sha:bundler|gems@K@", "gems@K@", "SERVICE")]),
         "dependencies": (DEP, [("sha:bundler|gems@K@", "rubygems", "rails", "~> 7.@K@", "compile"), ("sha:bundler|gems@K@", "rubygems", "puma", "6.@K@", "compile"), ("sha:bundler|gems@K@", "rubygems", "rspec", "3.12", "test"), ("sha:bundler|gems@K@", "rubygems", "pg", "*", "compile")])}),
    Sample("spring-components", [(f"{P}/java/OrderService.java", "package com.s@K@;\nimport org.springframework.stereotype.*;\n@Service\npublic class OrderService {}\n"), (f"{P}/java/OrderStore.java", "package com.s@K@;\nimport org.springframework.stereotype.*;\n@Transactional @Repository\npublic class OrderStore {}\n")],
        {"components": (COMP, [("sha:com.s@K@.OrderService", "OrderService", "SERVICE"), ("sha:com.s@K@.OrderStore", "OrderStore", "MODULE")])}),
    Sample("django-apps", [("dj@K@/site/settings.py", "INSTALLED_APPS = [\n  'django.contrib.admin',\n  'orders@K@',\n  'rest_framework@K@',\n]\n"), ("dj@K@/orders@K@/__init__.py", ""), ("dj@K@/orders@K@/apps.py", "class C:\n    verbose_name = 'Orders @K@'\n")],
        {"components": (COMP, [("sha:django|orders@K@", "Orders @K@", "MODULE"), ("sha:django|rest_framework@K@", "rest_framework@K@", "LIBRARY")])}),
    Sample("spring-rest-api", [(f"{P}/java/OrderController.java", 'package com.s@K@;\n@RestController\n@RequestMapping("/api/orders@K@")\npublic class OrderController {\n  @GetMapping("/{id}")\n  public Order get(@PathVariable Long id) { return null; }\n  @PostMapping\n  public Order create(@RequestBody Order o) { return o; }\n  @RequestMapping(value = "/all", method = RequestMethod.DELETE)\n  public void clear() {}\n}\n')],
        {"api_endpoints": (CALL, [("com.s@K@.OrderController", "/api/orders@K@/{id}", "GET", "PathVariable:id:Long", "Order"), ("com.s@K@.OrderController", "/api/orders@K@", "POST", "RequestBody:o:Order", "Order"), ("com.s@K@.OrderController", "/api/orders@K@/all", "DELETE", None, "void")])}),
    Sample("jaxrs-api", [(f"{P}/java/UserResource.java", 'package rs.s@K@;\nimport jakarta.ws.rs.*;\n@Path("users@K@")\npublic class UserResource {\n  @GET\n  @Path("/{id}")\n  public User one(@PathParam("id") long id) { return null; }\n  @POST\n  public User add(User u) { return u; }\n}\n')],
        {"api_endpoints": (CALL, [("rs.s@K@.UserResource", "users@K@/{id}", "GET", "PathParam:id:long", "User"), ("rs.s@K@.UserResource", "users@K@", "POST", None, "User")])}),
    Sample("grpc-service", [(f"{P}/java/PriceService.java", "package grpc.s@K@;\npublic class PriceService extends PricesGrpc.PricesImplBase {\n  @Override\n  public void quote(QuoteRequest req, StreamObserver<QuoteReply> out) {}\n}\n")],
        {"api_endpoints": (API + " request_schema response_schema", [("grpc.s@K@.PriceService", "/Prices/Quote", "POST", "QuoteRequest", "QuoteReply")])}),
    Sample("kafka-messaging", [(f"{P}/java/Consumer.java", 'package ev.s@K@;\npublic class Consumer {\n  @KafkaListener(topics = {"a@K@", "b@K@"}, groupId = "g")\n  @SendTo("c@K@")\n  public String on(String m) { kafkaTemplate.send("d@K@", m); kafkaTemplate.send(TOPIC, m); return m; }\n}\n')],
        {"message_flows": (FLOW, [(None, "ev.s@K@.Consumer", "a@K@"), (None, "ev.s@K@.Consumer", "b@K@"), ("ev.s@K@.Consumer", None, "c@K@"), ("ev.s@K@.Consumer", None, "d@K@"), ("ev.s@K@.Consumer", None, "TOPIC")])}),
    Sample("rabbitmq-messaging", [(f"{P}/java/Rabbit.java", 'package mq.s@K@;\npublic class Rabbit {\n  @RabbitListener(queues = "in@K@")\n  public void on(String m) { rabbitTemplate.convertAndSend("out@K@", m); }\n}\n')],
        {"message_flows": (FLOW, [(None, "mq.s@K@.Rabbit", "in@K@"), ("mq.s@K@.Rabbit", None, "out@K@")])}),
    Sample("kafka-streams", [(f"{P}/java/Topology.java", 'package st.s@K@;\npublic class Topology {\n  void build(StreamsBuilder builder) { builder.stream("raw@K@").through("mid@K@").to("done@K@"); builder.globalTable("dim@K@"); }\n}\n')],
        {"message_flows": (FLOW, [(None, "st.s@K@.Topology", "raw@K@"), (None, "st.s@K@.Topology", "dim@K@"), ("st.s@K@.Topology", None, "done@K@"), ("st.s@K@.Topology", None, "mid@K@"), (None, "st.s@K@.Topology", "mid@K@")])}),
    Sample("jpa-entities", [(f"{P}/java/OrderItem.java", 'package jpa.s@K@;\n@Entity\npublic class OrderItem {\n  @Id\n  private Long id;\n  @Column(name = "qty", nullable = false)\n  private int quantity;\n  private String noteText;\n  @ManyToOne\n  private Order@K@ parent;\n}\n')],
        {"data_entities": (ENT, [("jpa.s@K@.OrderItem", "order_item", "id", "id:Long:true,quantity:int:false,noteText:String:true")]),
         "relationships": (REL, [("jpa.s@K@.OrderItem", "Order@K@", "DEPENDS_ON")])}),
    Sample("mongodb", [(f"{P}/java/Profile.java", 'package mg.s@K@;\nimport org.springframework.data.mongodb.core.mapping.*;\n@Document(collection = "profiles@K@")\npublic class Profile {\n  @Id\n  private String id;\n  @Field("n")\n  private String name;\n  @DBRef\n  private List<Account@K@> accounts;\n}\n')],
        {"data_entities": (ENT, [("mg.s@K@.Profile", "profiles@K@", "id", "id:String:true,n:String:true")]),
         "relationships": (REL, [("mg.s@K@.Profile", "Account@K@", "DEPENDS_ON")])},
        also=(("jpa-entities", "data_entities", ENT, ("mg.s@K@.Profile", "profiles@K@", "id", "id:String:true,name:String:true,accounts:List<Account@K@>:true")),)),
    Sample("java-http-client", [(f"{P}/java/Clients.java", 'package cl@K@.web;\n@FeignClient(name = "stock@K@", url = "http://x")\ninterface Clients { }\nclass C { void f() { restTemplate.getForObject("http://billing/pay", X.class); restTemplate.getForObject("http://localhost/pay", X.class); webClient.get().uri("https://geo@K@/find"); webClient.get().uri("https://a.b.com/find"); } }\n')],
        {"relationships": (REL + " technology", [("cl@K@", "stock@K@", "CALLS", "Feign"), ("cl@K@", "billing", "CALLS", "RestTemplate"), ("cl@K@", "geo@K@", "CALLS", "WebClient")])}),
    Sample("fastapi-rest", [(f"{P}/py/api.py", 'from fastapi import FastAPI\n@app.get("/items@K@/{item_id}", response_model=dict)\nasync def read(item_id: int, q: str = None):\n    pass\n\n@app.post("/items@K@")\ndef add(item: Item):\n    pass\n')],
        {"api_endpoints": (API + " request_schema", [("s@K@.py.api", "/items@K@/{item_id}", "GET", "Path: item_id: int; Query: q: str"), ("s@K@.py.api", "/items@K@", "POST", "Body: item: Item")])}),
    Sample("flask-rest", [(f"{P}/py/web.py", "from flask import Flask\n@bp.route('/u@K@/<int:id>', methods=['GET', 'PUT'])\ndef user(id):\n    pass\n\n@bp.route('/health@K@')\ndef health():\n    pass\n\n@bp.delete('/u@K@')\ndef gone():\n    pass\n")],
        {"api_endpoints": (API + " request_schema", [("s@K@.py.web", "/u@K@/<int:id>", "GET", "id: int"), ("s@K@.py.web", "/u@K@/<int:id>", "PUT", "id: int"), ("s@K@.py.web", "/health@K@", "GET", None), ("s@K@.py.web", "/u@K@", "DELETE", None)])}),
    Sample("sqlalchemy-entities", [(f"{P}/py/tables.py", "from sqlalchemy import Column\nclass User@K@(Base):\n    __tablename__ = 'users@K@'\n    id = Column(Integer, primary_key=True)\n    name = Column(String(50), nullable=False)\n    team_id = Column(Integer, ForeignKey('teams@K@.id'))\n    posts = relationship('Post@K@')\n\nclass Plain(Mixin):\n    x = Column(Integer)\n")],
        {"data_entities": (ENT, [("s@K@.py.tables.User@K@", "users@K@", "id", "id:Integer:true,name:String:false,team_id:Integer:true")]),
         "relationships": (REL, [("s@K@.py.tables.User@K@", "Teams@K@", "DEPENDS_ON"), ("s@K@.py.tables.User@K@", "Post@K@", "DEPENDS_ON")])}),
    Sample("django-orm", [(f"{P}/py/models.py", "from django.db import models\nclass Article(models.Model):\n    title = models.CharField(max_length=9)\n    views = models.BigIntegerField(null=True)\n    at = models.DateTimeField()\n    author = models.ForeignKey('auth.User@K@', on_delete=models.CASCADE)\n")],
        {"data_entities": (ENT, [("s@K@.py.models.Article", "article", "id", "id:AutoField:false,title:VARCHAR:false,views:INTEGER:true,at:DATETIME:false")]),
         "relationships": (REL, [("s@K@.py.models.Article", "User@K@", "DEPENDS_ON")])}),
    Sample("celery-tasks", [(f"{P}/py/tasks.py", "from celery import shared_task\n@shared_task(queue='mail@K@')\ndef send@K@(x):\n    pass\n\n@app.task\ndef work@K@(x):\n    pass\n"), (f"{P}/py/views.py", "from celery import x\ndef go():\n    send@K@.delay(1)\n    work@K@.apply_async((1,), queue='fast@K@')\n    unknown.delay(2)\n")],
        {"message_flows": (FLOW, [("s@K@.py.views", "s@K@.py.tasks", "mail@K@"), ("s@K@.py.views", "s@K@.py.tasks", "fast@K@")])}),
    Sample("faust-streaming", [(f"{P}/py/stream.py", "import faust\nclicks = app.topic('clicks@K@')\n@app.agent(clicks)\nasync def count(events):\n    await other.send(value=1)\n    await clicks.send(value=2)\n")],
        {"message_flows": (FLOW, [(None, "s@K@.py.stream.count", "clicks@K@"), ("s@K@.py.stream", None, "other"), ("s@K@.py.stream", None, "clicks@K@")])}),
    Sample("aspnetcore-rest", [(f"{P}/net/OrdersController.cs", 'namespace Shop.S@K@;\n\n[ApiController]\n[Route("api/[controller]")]\npublic class OrdersController : ControllerBase\n{\n    [HttpGet("{id}")]\n    public async Task<ActionResult<Order>> Get(int id, string q) { }\n\n    [HttpPost]\n    public IActionResult Add([FromBody] Order order) { }\n}\n'), (f"{P}/net/Pages/Admin@K@/Index.cshtml.cs", "namespace Shop.Pages;\npublic class IndexModel : PageModel\n{\n    public void OnGet() { }\n}\n")],
        {"api_endpoints": (API + " request_schema", [("Shop.S@K@.OrdersController", "/api/orders/{id}", "GET", "Route: id: int; Query: q: string"), ("Shop.S@K@.OrdersController", "/api/orders", "POST", "Body: order: Order"), ("Shop.Pages.IndexModel", "/Admin@K@", "GET", None)])}),
    Sample("grpc-service-dotnet", [(f"{P}/net/GreeterService.cs", "namespace Grpc.S@K@;\n\npublic class GreeterService : Greeter.GreeterBase\n{\n    public override Task<HelloReply> SayHello(HelloRequest request, ServerCallContext context) { }\n}\n")],
        {"api_endpoints": (API + " request_schema response_schema", [("Grpc.S@K@.GreeterService", "/Greeter/SayHello", "POST", "HelloRequest", "HelloReply")])}),
    Sample("entity-framework", [(f"{P}/net/Db.cs", "namespace Db.S@K@;\n\npublic class ShopContext : DbContext\n{\n    public DbSet<Buyer@K@> Buyers { get; set; }\n}\n\npublic class Buyer@K@\n{\n    public int Id { get; set; }\n    public string? Name { get; set; }\n    public virtual ICollection<Basket@K@> Baskets { get; set; }\n}\n\npublic class Basket@K@ : BaseEntity\n{\n    public Guid Basket@K@Id { get; set; }\n    public Buyer@K@ Owner { get; set; }\n}\n")],
        {"data_entities": (ENT, [("Db.S@K@.Buyer@K@", "Buyer@K@s", "Id", "Id:INTEGER:false,Name:NVARCHAR:true"), ("Db.S@K@.Basket@K@", "Basket@K@s", "Basket@K@Id", "Basket@K@Id:UNIQUEIDENTIFIER:false")]),
         "relationships": (REL, [("Buyer@K@", "Basket@K@", "DEPENDS_ON"), ("Basket@K@", "Buyer@K@", "DEPENDS_ON")])}),
    Sample("dotnet-kafka-messaging", [(f"{P}/net/Bus.cs", 'using Confluent.Kafka;\nnamespace Bus.S@K@;\npublic class Bus\n{\n    private readonly IProducer<string, string> _p;\n    void F() { _c.Subscribe("in@K@"); _p.ProduceAsync("out@K@", m); }\n}\n')],
        {"message_flows": (FLOW, [("unknown-publisher", "Bus.S@K@.Bus", "in@K@"), ("Bus.S@K@.Bus", "unknown-subscriber", "out@K@"), ("Bus.S@K@.Bus", "unknown-subscriber", "unknown-topic")])}),
    Sample("streamiz-kafka", [(f"{P}/net/Flow.cs", 'using Streamiz.Kafka.Net;\nnamespace Flow.S@K@;\npublic class Flow\n{\n    void F() { builder.Stream<string, string>("x@K@").To("y@K@"); }\n}\n')],
        {"message_flows": (FLOW, [(None, "Flow.S@K@.Flow", "x@K@"), ("Flow.S@K@.Flow", None, "y@K@")])}),
    Sample("express-api", [(f"{P}/web/shop@K@.js", "const express = require('express');\nrouter.get('/cart@K@', f);\napp.post(\"/cart@K@/:id\", f);\n")],
        {"api_endpoints": (API, [("shop@K@", "/cart@K@", "GET"), ("shop@K@", "/cart@K@/:id", "POST")])}),
    Sample("go-http-router", [(f"{P}/go/main.go", 'package web@K@\n\nimport "github.com/gin-gonic/gin"\n\nfunc main() {\n\tapi := r.Group("/api")\n\tv1 := api.Group("/v1")\n\tv1.GET("/orders@K@", list)\n\tr.POST("/ping@K@", ping)\n}\n')],
        {"api_endpoints": (API, [("web@K@", "/api/v1/orders@K@", "GET"), ("web@K@", "/ping@K@", "POST")])}),
    Sample("grpc-service-go", [(f"{P}/go/server.go", 'package rpc@K@\n\nimport "google.golang.org/grpc"\n\nfunc (s *server) Say(ctx context.Context, in *pb.Ask) (*pb.Reply, error) { return nil, nil }\n\nfunc main() { pb.RegisterTalkServer(g, &server{}) }\n')],
        {"api_endpoints": (API + " request_schema response_schema", [("rpc@K@", "/Talk/Say", "POST", "Ask", "Reply")])}),
    Sample("go-struct", [(f"{P}/go/model.go", 'package model@K@\n\ntype UserAccount struct {\n\tID int64 `gorm:"primaryKey"`\n\tFullName string `gorm:"column:name;not null"`\n\tScore *float64 `db:"score"`\n}\n\ntype Plain struct {\n\tX int\n}\n')],
        {"data_entities": (ENT, [("model@K@", "user_accounts", "id", "id:INTEGER:false,name:VARCHAR:false,score:FLOAT:true")])}),
    Sample("rails-api", [(f"{P}/rb/app/controllers/orders_controller.rb", "class Api@K@::OrderItemsController < ApplicationController\n  def index\n  end\n  def update\n  end\n  def export\n  end\n  private\n  def secret\n  end\nend\n")],
        {"components": (COMP, [("sha:rails|Api@K@::OrderItems", "Api@K@::OrderItemsController", "SERVICE")]),
         "api_endpoints": (API, [("sha:rails|Api@K@::OrderItems", "/api@K@/order_items", "GET"), ("sha:rails|Api@K@::OrderItems", "/api@K@/order_items/:id", "PUT"), ("sha:rails|Api@K@::OrderItems", "/api@K@/order_items/export", "GET")])}),
    Sample("rails-route", [("rr@K@/config/routes.rb", "Rails.application.routes.draw do\n  namespace :admin do\n    resources :posts, only: [:index, :update]\n  end\n  resource :profile, only: [:show]\n  get '/health', to: 'h#x'\nend\n")],
        {"api_endpoints": (API, [("sha:rails-routes|rr@K@", "/admin/posts", "GET"), ("sha:rails-routes|rr@K@", "/admin/posts/:id", "PATCH"), ("sha:rails-routes|rr@K@", "/profile", "GET"), ("sha:rails-routes|rr@K@", "/health", "GET")])}),
    Sample("sidekiq-jobs", [(f"{P}/rb/mail.rb", "module Jobs@K@\n  class Mailer\n    include Sidekiq::Worker\n    sidekiq_options queue: :mail@K@\n  end\nend\n"), (f"{P}/rb/caller.rb", "class Caller@K@\n  def go\n    Jobs@K@::Mailer.perform_async(1)\n    Nobody.perform_in(1)\n  end\nend\n")],
        {"message_flows": (FLOW, [("Caller@K@", "Jobs@K@::Mailer", "mail@K@")])}),
    Sample("graphql-schema", [(f"{P}/schema/shop@K@.graphql", "type Query {\n  order(id: ID!): Order\n}\ntype Order {\n  id: ID!\n  lines: [Line!]\n}\n")],
        {"api_endpoints": (API + " request_schema response_schema", [("shop@K@", "order", "QUERY", "id: ID", "Order")]),
         "data_entities": (ENT, [("shop@K@", "Order", "id", "id:ID:false,lines:[Line]:true")])}),
    Sample("graphql-schema", [(f"{P}/schema/deep@K@.gql", 'schema { query: Query }\ndirective @auth(role: Role = {a: "}"}) repeatable on OBJECT | FIELD_DEFINITION\n"""\ntype Old { gone: Int }\n"""\ntype Query @auth(role: {a: ["}", 1]}) {\n  "first { field }"\n  a(x: In = {k: 1, l: [{m: 2}]}, y: [Int!]! = [1, 2] @old): T!\n  b: [[T!]!]! @deprecated(reason: "none (yet)")\n}\nextend type Query { c: Int }\ninterface Node { id: ID! }\nunion Hit = | T | U\nenum Color { RED @old GREEN }\nscalar Date\ntype T implements Node & Other @key(fields: "id") {\n  # note: String\n  ref: ID!\n  note(size: Int = 3): String\n}\ninput In {\n  k: Int! = 3\n  l: [In] = [{k: 1}]\n}\n')],
        {"api_endpoints": (API + " request_schema response_schema", [("deep@K@", "a", "QUERY", "x: In, y: [Int]", "T"), ("deep@K@", "b", "QUERY", None, "[[T]]"), ("deep@K@", "c", "QUERY", None, "Int")]),
         "data_entities": (ENT, [("deep@K@", "T", "ref", "ref:ID:false,note:String:true"), ("deep@K@", "In", None, "k:Int:false,l:[In]:true")])}, when=(2, 0)),
    Sample("protobuf-schema", [(f"{P}/schema/deep.proto", 'syntax = "proto3";\npackage deep.v@K@;\nmessage Outer {\n  /* string old = 9; */\n  string id = 1 [(rule) = {a: "}"}];\n  message Inner { required bool on = 1; }\n  oneof pick {\n    int32 num = 2;\n    string txt = 3;\n  }\n  map<string, Inner> all = 4;\n  reserved 5;\n}\nservice Deep {\n  rpc Watch (stream Outer) returns (stream .deep.Inner) {\n    option (http) = { get: "/x/{id}" };\n  }\n  rpc Next(Outer) returns (Outer);\n}\n')],
        {"api_endpoints": (API, [("deep.v@K@", "/deep.v@K@.Deep/Watch", "POST"), ("deep.v@K@", "/deep.v@K@.Deep/Next", "POST")]),
         "data_entities": (ENT, [("deep.v@K@", "Outer", None, "id:string:true,num:int32:true,txt:string:true,all:map<string, Inner>:true"), ("deep.v@K@", "Inner", None, "on:bool:false")])}, when=(2, 1)),
    Sample("sql-migration", [(f"{P}/db/migration/V2__more@K@.sql", "/* CREATE TABLE old (x INT); */\nCREATE TABLE shop.lines@K@ (\n  \"code\" VARCHAR(9) DEFAULT 'a;b)' NOT NULL,\n  price NUMERIC(9, 2) CHECK (price > (1 + 2)),\n  head_id BIGINT NOT NULL REFERENCES heads@K@ (id) ON DELETE CASCADE,\n  at TIMESTAMP DEFAULT (now()),\n  CONSTRAINT pk PRIMARY KEY (code, head_id),\n  UNIQUE (code)\n);\nCREATE INDEX i ON lines@K@ (code);\n")],
        {"data_entities": (ENT, [("V2__more@K@", "lines@K@", "code", "code:VARCHAR(9):false,price:NUMERIC(9, 2):true,head_id:BIGINT:false,at:TIMESTAMP:true")]),
         "relationships": (REL, [("lines@K@", "heads@K@", "DEPENDS_ON")])}, when=(2, 0)),
    Sample("express-api", [(f"{P}/web/late@K@.js", "const express = require('express');\n// app.get('/gone@K@', h);\n/* router.post('/gone@K@', h); */\nconst re = /[\"'`]\\/\\/app.get('\\/no')/;\nconst url = 'http://x/'; app.put(`/kept@K@`, h); // app.delete('/gone')\n")],
        {"api_endpoints": (API, [("late@K@", "/kept@K@", "PUT")])}, when=(2, 1)),
    Sample("aspnetcore-rest", [(f"{P}/net/DeepController.cs", 'namespace Deep.S@K@\n{\n    /* [HttpGet("gone")] public int Gone() { } */\n    [Route("v1/deep@K@"), Authorize(Policy = "a(b[c])")]\n    public sealed class DeepController : Base<Dictionary<string, int>>\n    {\n        // [HttpDelete] public void No() { }\n        [HttpPut("{id:int}/x"), Produces("a/b")]\n        public virtual async Task<ActionResult<List<Hit>>> Put([FromRoute] int id, [FromBody] Hit hit = default(Hit), CancellationToken stop = default) { return f("}"); }\n        private class Inner { [HttpGet("inner")] int No() { } }\n    }\n    public class Helper\n    {\n        [HttpGet("helper")]\n        public int Helps() { return 1; }\n    }\n}\n')],
        {"api_endpoints": (API + " request_schema", [("Deep.S@K@.DeepController", "/v1/deep@K@/{id:int}/x", "PUT", "Route: id: int; Body: hit: Hit")])}, when=(2, 0)),
    Sample("rails-api", [(f"{P}/rb/app/controllers/late_controller.rb", "class LateController < ApplicationController\n  # def gone\n  def show\n    items.each do |i|\n      puts \"end # def no\" if i\n    end\n    x = if y then 1 else 2 end\n  end\n  private\n  def secret; end\n  public\n  def open@K@\n  end\nend\nclass Helper\n  def helps\n  end\nend\n")],
        {"components": (COMP, [("sha:rails|Late", "LateController", "SERVICE")]),
         "api_endpoints": (API, [("sha:rails|Late", "/late/:id", "GET"), ("sha:rails|Late", "/late/open@K@", "GET")])}, when=(2, 0)),
    Sample("protobuf-schema", [(f"{P}/schema/shop.proto", 'syntax = "proto3";\npackage shop.v@K@;\nmessage Order {\n  string id = 1;\n  repeated Line lines = 2; // all\n}\nservice Orders {\n  rpc Get (Ask) returns (Order);\n}\n')],
        {"api_endpoints": (API, [("shop.v@K@", "/shop.v@K@.Orders/Get", "POST")]),
         "data_entities": (ENT, [("shop.v@K@", "Order", None, "id:string:true,lines:Line:true")])}),
    Sample("avro-schema", [(f"{P}/schema/order.avsc", '{"type": "record", "name": "OrderEvent", "namespace": "ev.n@K@", "fields": [{"name": "id", "type": "long"}, {"name": "note", "type": ["null", "string"]}, {"name": "tags", "type": {"type": "array", "items": "string"}}]}')],
        {"data_entities": (ENT, [("ev.n@K@", "OrderEvent", None, "id:long:false,note:string:true,tags:array<string>:false")]),
         "message_flows": (FLOW, [("ev.n@K@", None, "OrderEvent")])}),
    Sample("sql-migration", [(f"{P}/db/migrations/V@K@__init.sql", "-- first\nCREATE TABLE IF NOT EXISTS accounts (\n  id INTEGER PRIMARY KEY,\n  email VARCHAR(99) NOT NULL,\n  team_id INTEGER,\n  FOREIGN KEY (team_id) REFERENCES teams@K@(id)\n);\n")],
        {"data_entities": (ENT, [("V@K@__init", "accounts", "id", "id:INTEGER:false,email:VARCHAR(99):false,team_id:INTEGER:true")]),
         "relationships": (REL, [("accounts", "teams@K@", "DEPENDS_ON")])}),
    Sample("maven-dependencies", [(f"{P}/torn/pom.xml", "<project><artifactId>torn@K@</artifactId><dependencies><dependency><groupId>lost.g@K@</groupId><artifactId>thing</artifactId></dependency>")],
        {"dependencies": (DEP, [("unknown", "lost.g@K@", "thing", None, "compile")])}, when=(4, 0)),
    Sample("maven-dependencies", [(f"{P}/plug/pom.xml", """<?xml version="1.0"?>
<!-- build --><project><groupId>pl.g@K@</groupId><artifactId>plug@K@</artifactId><version>3</version><packaging>war</packaging>
<dependencyManagement><dependencies><dependency><groupId>man.g@K@</groupId><artifactId>aged</artifactId><version>7</version><scope>runtime</scope></dependency></dependencies></dependencyManagement>
<build><plugins><plugin><groupId>x</groupId><artifactId>y</artifactId><dependencies><dependency><groupId>no.g@K@</groupId><artifactId>no</artifactId></dependency></dependencies></plugin></plugins></build></project>""")],
        {"components": (COMP, [("sha:maven|pl.g@K@|plug@K@", "plug@K@", "SERVICE")]), "dependencies": (DEP, [("plug@K@", "man.g@K@", "aged", "7", "runtime")])}, when=(4, 1)),
    # broken code files: what can be read of them is read
    Sample("spring-rest-api", [(f"{P}/java/TornController.java", 'package to.s@K@;\n@RestController\npublic class TornController {\n  @GetMapping("/torn@K@")\n  public String get() {\n    return f("";\n')],
        {"api_endpoints": (CALL, [("to.s@K@.TornController", "/torn@K@", "GET", None, "String")])}, when=(4, 3)),
    Sample("fastapi-rest", [(f"{P}/py/torn.py", 'from fastapi import FastAPI\n@app.get("/torn@K@")\ndef read(key: str):\n    x = f(\n')],
        {"api_endpoints": (API + " request_schema", [("s@K@.py.torn", "/torn@K@", "GET", "Query: key: str")])}, when=(4, 2)),
    Sample("go-struct", [(f"{P}/go/torn.go", 'package torn@K@\n\ntype Torn struct {\n\tID int64 `gorm:"primaryKey"`\n')],
        {"data_entities": (ENT, [("torn@K@", "torns", "id", "id:INTEGER:false")])}, when=(4, 1)),
    Sample("aspnetcore-rest", [(f"{P}/net/TornController.cs", 'namespace To.S@K@;\n[ApiController]\npublic class TornController : ControllerBase\n{\n    [HttpGet("a@K@")]\n    public int Get(int id) { return f(1; }\n')],
        {"api_endpoints": (API + " request_schema", [("To.S@K@.TornController", "/api/torn/a@K@", "GET", "Query: id: int")])}, when=(4, 0)),
    Sample("graphql-schema", [(f"{P}/schema/torn@K@.graphql", 'type Query {\n  kept(id: ID!): Int\n}\ntype Torn {\n  id: ID!\n')],
        {"api_endpoints": (API + " request_schema response_schema", [("torn@K@", "kept", "QUERY", "id: ID", "Int")])}, when=(4, 3)),
    Sample("protobuf-schema", [(f"{P}/schema/torn.proto", 'syntax = "proto3";\npackage torn.v@K@;\nmessage Torn {\n  string id = 1;\n')],
        {"data_entities": (ENT, [("torn.v@K@", "Torn", None, "id:string:true")])}, when=(4, 2)),
    Sample("express-api", [(f"{P}/web/torn@K@.js", "const express = require('express');\napp.get('/torn@K@', function () {\n")],
        {"api_endpoints": (API, [("torn@K@", "/torn@K@", "GET")])}, when=(4, 1)),
    Sample("npm-dependencies", [(f"{P}/torn/package.json", '{"name": "torn@K@", "dependencies": {')], {}, when=(4, 2)),
    Sample("bundler-dependencies", [("rb/nest@K@/Gemfile", "source 'https://rubygems.org' do\n  gem 'outer@K@'\n  group :development, :test do\n    platforms :ruby do\n      gem 'byebug@K@', '11'\n    end\n    gem 'rspec@K@', '~> 3'\n  end\n  gem 'late@K@'\nend\n")],
        {"components": (COMP, [("sha:bundler|nest@K@", "nest@K@", "SERVICE")]),
         "dependencies": (DEP, [("sha:bundler|nest@K@", "rubygems", "outer@K@", "*", "compile"), ("sha:bundler|nest@K@", "rubygems", "byebug@K@", "11", "test"), ("sha:bundler|nest@K@", "rubygems", "rspec@K@", "~> 3", "test"), ("sha:bundler|nest@K@", "rubygems", "late@K@", "*", "compile")])}, when=(3, 0)),
    Sample("spring-rest-api", [(f"{P}/java/SearchController.java", 'package se.s@K@;\n@RestController\npublic class SearchController {\n  @GetMapping(value = {"/find@K@", "/search@K@"}, produces = "x/y")\n  public Map<String, Hit> find(@RequestParam(name = "q", required = false) String q, @RequestHeader("X") String x, Pageable page) { return null; }\n  @RequestMapping(path = "any@K@", method = {RequestMethod.PUT, RequestMethod.PATCH})\n  ResponseEntity<?> any(@Valid @RequestBody final Hit hit) { return null; }\n}\nclass NoController {\n  @GetMapping("/no")\n  public String no() { return ""; }\n}\n')],
        {"api_endpoints": (CALL, [("se.s@K@.SearchController", p, "GET", "RequestParam:q:String, RequestHeader:x:String", "Map<String, Hit>") for p in ("/find@K@", "/search@K@")] + [("se.s@K@.SearchController", "/any@K@", m, "RequestBody:hit:Hit", "ResponseEntity<?>") for m in ("PUT", "PATCH")])}, when=(3, 1)),
    Sample("spring-rest-api", [(f"{P}/java/DeepController.java", 'package de.s@K@;\n/* @RestController class Old { @PutMapping("/old") void no() {} } */\n@RestController\n@Guarded(rule = @Rule(any(of("a", b(c("}"))))))\n@RequestMapping(path = "/deep@K@")\npublic class DeepController extends Base<Map<String, Integer>> {\n  // @GetMapping("/gone") String gone() {}\n  @GetMapping("/x")\n  @PreAuthorize("hasPermission(#id, T(a.B).of(#id))")\n  public List<Map<String, Hit>> x(@PathVariable("id") final Long id, @RequestParam(defaultValue = "a,b=(") String q) { if (q != null) { return f(q); } return null; }\n  private final Map<String, Integer> seen = new HashMap<>() {{ put("a", 1); }};\n  static class Inner {\n    @GetMapping("/inner") String inner() { return "}"; }\n  }\n  public @ResponseBody @PostMapping(value = "/y", params = {"a", "b"}) Hit y(@RequestBody Hit hit) throws IOException { return hit; }\n}\nclass Helper {\n  @GetMapping("/helper") public String helper() { return ""; }\n}\n')],
        {"api_endpoints": (CALL, [("de.s@K@.DeepController", "/deep@K@/x", "GET", "PathVariable:id:Long, RequestParam:q:String", "List<Map<String, Hit>>"), ("de.s@K@.DeepController", "/deep@K@/y", "POST", "RequestBody:hit:Hit", "Hit")])}, when=(3, 0)),
    Sample("jpa-entities", [(f"{P}/java/Account.java", 'package ac.s@K@;\n@Table(name = "accounts@K@", indexes = @Index(columnList = "a(b(c))"))\n@Entity\npublic class Account {\n  public static final int MOST = 3;\n  @Id Long key;\n  private String first, last;\n  @Column(nullable = false, columnDefinition = "text default (now((1)))")\n  protected final String note = "a;b{";\n  private byte[] raw;\n  @OneToMany(mappedBy = "account", cascade = {CascadeType.ALL}) Set<Item@K@> items;\n  public String getNote() { String local = note; return local; }\n  enum Kind { A, B }\n}\nclass Plain {\n  private int notMine;\n}\n')],
        {"data_entities": (ENT, [("ac.s@K@.Account", "accounts@K@", "key", "MOST:int:true,key:Long:true,first:String:true,last:String:true,note:String:false,raw:byte:true")]),
         "relationships": (REL, [("ac.s@K@.Account", "Item@K@", "DEPENDS_ON")])}, when=(2, 1)),
    Sample("jaxrs-api", [(f"{P}/java/PetResource.java", 'package pe.s@K@;\nimport javax.ws.rs.*;\n@Path("/pets@K@")\n@Produces(MediaType.APPLICATION_JSON)\n@Consumes({"a/b", "c/d"})\npublic class PetResource {\n  @Path("list")\n  @GET\n  public List<Pet> list(@QueryParam("q") String q, @HeaderParam("h") int h, @Context Request r) { return null; }\n  @PUT\n  @Produces("text/plain")\n  public String put(Pet pet) { return ""; }\n}\n')],
        {"api_endpoints": (CALL, [("pe.s@K@.PetResource", "/pets@K@/list", "GET", "QueryParam:q:String, HeaderParam:h:int", "List<Pet> (application/json)"), ("pe.s@K@.PetResource", "/pets@K@", "PUT", "a/b, c/d", "String (text/plain)")])}, when=(3, 2)),
    Sample("entity-framework", [(f"{P}/net/Deep.cs", "namespace Deep.S@K@;\n\npublic class Root@K@ : AuditableEntity\n{\n    public TimeSpan Took { get; set; }\n    public Status State { get; set; }\n}\n\npublic class Mid@K@ : Root@K@\n{\n    public byte[] Raw { get; set; }\n}\n\npublic class Low@K@ : Mid@K@\n{\n    public DateTimeOffset? At { get; set; }\n}\n\npublic class Last@K@ : Low@K@\n{\n    public float Share { get; set; }\n    public List<Root@K@> Roots { get; set; }\n}\n\npublic class Other@K@ : Unrelated\n{\n    public int Id { get; set; }\n}\n")],
        {"data_entities": (ENT, [("Deep.S@K@.Root@K@", "Root@K@s", None, "Took:TIME:false,State:STATUS:false"), ("Deep.S@K@.Mid@K@", "Mid@K@s", None, "Raw:VARBINARY:false"), ("Deep.S@K@.Low@K@", "Low@K@s", None, "At:DATETIMEOFFSET:true"), ("Deep.S@K@.Last@K@", "Last@K@s", None, "Share:REAL:false")]),
         "relationships": (REL, [("Last@K@", "Root@K@", "DEPENDS_ON")])}, when=(2, 1)),
    Sample("go-struct", [(f"{P}/go/wide.go", 'package wide@K@\n\ntype Order struct {\n\tgorm.Model\n\tTotal Money `gorm:"column:total"`\n\tLines uint64 `gorm:"not null"`\n\tRaw []byte `gorm:"size:9"`\n}\n')],
        {"data_entities": (ENT, [("wide@K@", "orders", "id", "id:INTEGER:false,created_at:TIMESTAMP:true,updated_at:TIMESTAMP:true,deleted_at:TIMESTAMP:true,total:Money:true,lines:INTEGER:false,raw:BLOB:true")])}, when=(2, 0)),
    Sample("django-orm", [(f"{P}/py/blog_models.py", "from django.db import models\nclass Post@K@(models.Model):\n    key = models.BigAutoField(primary_key=True)\n    body = models.TextField(blank=True)\n    spot = models.PointField()\n    cost = models.DecimalField(max_digits=9)\n")],
        {"data_entities": (ENT, [("s@K@.py.blog_models.Post@K@", "post@K@", "key", "key:SERIAL:false,body:VARCHAR:true,spot:PointField:false,cost:DECIMAL:false")])}, when=(2, 1)),
    Sample("sqlalchemy-entities", [(f"{P}/py/wide.py", 'import sqlalchemy as sa\nfrom sqlalchemy import Column\n\nclass Base(DeclarativeBase):\n    x = Column(Integer)\n\nclass Line@K@(Base):\n    """class Fake(Base):\n    y = Column(Integer)"""\n    __tablename__ = "lines@K@"\n    id = Column(\n        Integer,  # key (\n        primary_key=True,\n    )\n    note = Column(Text(fn(a(b))),\n        nullable=False)\n    head_id = Column(Integer, ForeignKey("order_heads@K@.id"))\n    head = relationship(\n        "Head@K@", back_populates="lines")\n    class Meta:\n        z = Column(Integer)\n    def f(self):\n        inner = Column(Integer)\n        return inner\n\ndef after():\n    late = Column(Integer)\n\nclass Item@K@(SQLModel, table=True):\n    id: int | None = Field(default=None, primary_key=True)\n    owner_id: int = Field(\n        foreign_key="user@K@.id", nullable=False)\n    owner: "User@K@" = Relationship()\n    other = Column(Integer)\n')],
        {"data_entities": (ENT, [("s@K@.py.wide.Line@K@", "lines@K@", "id", "id:Integer:true,note:Text:false,head_id:Integer:true"), ("s@K@.py.wide.Item@K@", "item@K@", "id", "id:int | None:true,owner_id:Integer:false")]),
         "relationships": (REL, [("s@K@.py.wide.Line@K@", "OrderHeads@K@", "DEPENDS_ON"), ("s@K@.py.wide.Line@K@", "Head@K@", "DEPENDS_ON"), ("s@K@.py.wide.Item@K@", "User@K@", "DEPENDS_ON"), ("s@K@.py.wide.Item@K@", "User@K@", "DEPENDS_ON")])}, when=(3, 1)),
    Sample("django-orm", [(f"{P}/py/late_models.py", "from django.db import models\nclass Entry@K@(models.Model):\n    body = models.TextField(\n        blank=f(g(1)),\n        null=True,\n    )\n    owner = models.ForeignKey(\n        to='auth.Owner@K@',\n        on_delete=models.CASCADE)\n    class Meta:\n        ordering = ['x']\n        inner = models.CharField()\n\ndef after():\n    q = models.CharField()\n\nclass Other(Mixin):\n    z = models.CharField()\n")],
        {"data_entities": (ENT, [("s@K@.py.late_models.Entry@K@", "entry@K@", "id", "id:AutoField:false,body:VARCHAR:true")]),
         "relationships": (REL, [("s@K@.py.late_models.Entry@K@", "Owner@K@", "DEPENDS_ON")])}, when=(3, 2)),
    Sample("fastapi-rest", [(f"{P}/py/deep.py", 'from fastapi import APIRouter\nrouter = APIRouter()\n# @router.get("/gone@K@")\n@router.get(\n    "/deep@K@/{key}",\n    dependencies=[Depends(f(g(h(1))))],\n)\n@other(x(y(z())))\nasync def read(key: str, limit: int = Query(10, ge=min(1, 2)), item: Dict[str, Item] = Depends(a(b(c)))):\n    pass\n\ndef make(app):\n    @app.delete("/inner@K@")\n    def gone(): pass\n')],
        {"api_endpoints": (API + " request_schema", [("s@K@.py.deep", "/deep@K@/{key}", "GET", "Path: key: str; Query: limit: int"), ("s@K@.py.deep", "/inner@K@", "DELETE", None)])}, when=(2, 0)),
    Sample("sqlalchemy-entities", [(f"{P}/py/mapped.py", "from sqlalchemy.orm import Mapped, mapped_column\nclass Tag@K@(Base):\n    id: Mapped[int] = mapped_column(primary_key=True)\n    label: Mapped[Optional[str]] = mapped_column(String(9))\n    price: Mapped[Decimal] = mapped_column(nullable=False)\n")],
        {"data_entities": (ENT, [("s@K@.py.mapped.Tag@K@", "tag@K@", "id", "id:Integer:true,label:String:true,price:Numeric:false")])}, when=(2, 0)),
    Sample("dotnet-kafka-messaging", [(f"{P}/net/Two.cs", 'using Confluent.Kafka;\nnamespace Two.S@K@;\n\npublic class Hears\n{\n    [KafkaConsumer("heard@K@")]\n    public void On(string m) { }\n}\n\npublic class Says\n{\n    void F() { _p.Produce("said@K@", m); }\n}\n')],
        {"message_flows": (FLOW, [("unknown-publisher", "Two.S@K@.Hears", "heard@K@"), ("Two.S@K@.Hears", "unknown-subscriber", "said@K@"), ("Two.S@K@.Says", "unknown-subscriber", "said@K@")])}, when=(3, 0)),
    Sample("go-http-router", [(f"{P}/go/deep.go", 'package deep@K@\n\nimport "github.com/gorilla/mux"\n\nfunc main() {\n\ta := r.Group("/a")\n\tb := a.Group("/b")\n\tc := b.Group("/c")\n\td := c.Group("/d")\n\te := d.Group("/e")\n\tf := e.Group(`/f`)\n\tg := f.Group("/g")\n\tg.GET("/deep@K@", h)\n\tx := y.Group("/x")\n\ty := x.Group("/y")\n\tr.HandleFunc("/both@K@", h).Methods("GET", "PUT")\n}\n')],
        {"api_endpoints": (API, [("deep@K@", "/a/b/c/d/e/f/g/deep@K@", "GET"), ("deep@K@", "/both@K@", "GET"), ("deep@K@", "/both@K@", "PUT")])}, when=(3, 1)),
    Sample("sidekiq-jobs", [(f"{P}/rb/quoted.rb", "class Sweep@K@\n  include Sidekiq::Job\n  sidekiq_options retry: 3, queue: 'low@K@'\nend\nclass Night@K@\n  def go\n    Sweep@K@.set(wait: 3).perform_async\n  end\nend\n")],
        {"message_flows": (FLOW, [("Night@K@", "Sweep@K@", "low@K@")])}, when=(2, 0)),
    Sample("rails-route", [("rq@K@/config/routes.rb", 'Rails.application.routes.draw do\n  get :about@K@\n  post "/pay@K@" => "pay#now"\n  get "home" # get "no"\n  match "/m@K@", via: [:get, :delete]\nend\n')],
        {"api_endpoints": (API, [("sha:rails-routes|rq@K@", "/about@K@", "GET"), ("sha:rails-routes|rq@K@", "/pay@K@", "POST"), ("sha:rails-routes|rq@K@", "/home", "GET"), ("sha:rails-routes|rq@K@", "/m@K@", "GET"), ("sha:rails-routes|rq@K@", "/m@K@", "DELETE")])}, when=(3, 2)),
    Sample("kafka-messaging", [(f"{P}/java/Silent.java", 'package no.s@K@;\n// @KafkaListener is not used here\npublic class Silent {\n  public String on(String m) { return m; }\n}\n')], {}, when=(2, 0)),
]


def derived_files(spark: SparkSession, sf_dir: str, scanners: list[str] | None = None) -> DataFrame:
    """(rel_path, content): the projects of all suppliers, with the files of all or of the named scanners."""
    chosen = [(p, t, *s.when) for s in SAMPLES if scanners is None or s.scanner in scanners for p, t in s.files]
    one = [F.struct(F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(m).alias("m"), F.lit(r).alias("r")) for p, t, m, r in chosen]
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("n"), F.col("s_suppkey").cast("string").alias("k"))
    # keys are few bytes, and what is made of them is many: the work is spread before it begins
    keys = suppliers.repartition(spark.sparkContext.defaultParallelism, "n").select("n", "k", F.explode(F.array(*one)).alias("f"))
    put = lambda c: F.replace(c, F.lit("@K@"), F.col("k"))
    return keys.where(F.col("n") % F.col("f.m") == F.col("f.r")).select(put(F.col("f.p")).alias("rel_path"), put(F.col("f.t")).alias("content"))


def text_sql(text: str) -> str:
    """SQL for a text of the samples, with the supplier's key put in."""
    return "replace('{}', '@K@', s_suppkey::VARCHAR)".format(text.replace("'", "''"))


def _sql(v: object) -> str:
    if isinstance(v, bool):
        return str(v)
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    made = text_sql(str(v).removeprefix("sha:"))
    return f"substr(sha256({made}), 1, 16)" if str(v).startswith("sha:") else made


def _rows_sql(names: list[str], row: tuple, when: tuple[int, int]) -> str:
    return "SELECT " + ", ".join(f"{_sql(v)} AS {n}" for n, v in zip(names, row, strict=True)) + f" FROM supplier WHERE s_suppkey % {when[0]} = {when[1]}"


def expected_sql(scanner: str, table: str) -> str:
    """SQL for what the scanner has to find in derived_files(), from the supplier table."""
    parts = [_rows_sql(s.finds[table][0].split(), row, s.when) for s in SAMPLES if s.scanner == scanner and table in s.finds for row in s.finds[table][1]]
    parts += [_rows_sql(c.split(), row, s.when) for s in SAMPLES for i, t, c, row in s.also if (i, t) == (scanner, table)]
    return "\nUNION ALL ".join(parts)


def keys_sql(table: str, key: list[str]) -> str:
    """SQL for the distinct keys of all that scanners have to find for a table in derived_files()."""
    parts = []
    for s in SAMPLES:
        for t, columns, found in [(t, c.split(), r) for t, (c, r) in s.finds.items()] + [(t, c.split(), [r]) for _, t, c, r in s.also]:
            if t == table:
                parts += [_rows_sql(key, tuple(dict(zip(columns, row, strict=True)).get(k) for k in key), s.when) for row in found]
    return "\nUNION ".join(parts)
